"""How the sources of a language differ in their words: Gustavson's row accumulation over a term-major index.

Each language keeps the terms of at least `min_docs` of its documents. A source, or the language, gives each
kept term the smoothed share p = 1 + floor(SCALE * (n + 5) / (N + 5 V)) in whole numbers: n occurrences there,
N over all kept terms, V kept terms. Two sources differ by the sum of |p - q| over all kept terms.

The counts by source and term are a sparse matrix; what a source has of a term that it lacks is its zero
share z. Terms are dealt into slabs; a slab holds its postings by term and the zero shares of all sources.
Each source scatters its terms through the postings into one dense accumulator over its peers, so no pair of
postings becomes a row: a slab gives one number for two sources. What the zero shares stand for is put right in it:

    |p - q| for both, as a change from the sum of |p - z_b| and |z_a - q|, less |z_a - z_b|;
    |p - z_b| - |z_a - z_b| over a's own terms, from sorted shares and their running sums;
    |z_a - z_b| for each term of the slab.

S sources give S * (S - 1) rows of the result and as many numbers a slab, so a slab has about S * S postings of its
language, between LEAST and MOST: its memory is bounded by that and by one accumulator of S numbers.

Defined cases: null texts, langs and sources are empty; a source without kept terms has the zero share for
all; a language without kept terms has pairs of value 0 and no terms; repeated rows count again; a language of
one source has no pairs; extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, null_safe_text, read_table

MIN_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
#: Bounds of a slab's postings, counters of a task before it hands them on, and posting pairs that are looked at together.
LEAST = 1 << 14
MOST = 1 << 21
HELD = 200_000
PAIRS = 1 << 20

#: Letters of ASCII in lower case and all other characters are parts of a term, the rest is between terms.
_TERM_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


# --- counts

def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of what a task has read, and a row without a term for each group."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in seen.items():
            names = pa.array([None, *n], pa.binary()).cast(pa.string())
            own = [pa.array([x] * len(names), pa.string()) for x in (lang, source)]
            yield pa.record_batch([*own, names, pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())], ["lang", "source", "term", "n", "docs"])
        seen.clear()

    for batch in batches:
        for lang, source, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
            n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
            w = terms(t.as_buffer().to_pybytes())
            n.update(w)
            docs.update(set(w))
        if sum(len(n) for n, _ in seen.values()) > HELD:
            yield from handed_on()
    yield from handed_on()


def kept_counts(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first): n of each kept term of a source and over its language; first marks one
    source a term. Each source also has a row without a term and n = 0."""
    own = df.select(null_safe_text(lang).alias("lang"), null_safe_text(source).alias("source"), null_safe_text(text).alias("body"))
    counts = own.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")  # a row a source
    counts = counts.select(
        "lang", "source", "term", "n", F.sum("n").over(same).alias("lang_n"), F.sum("docs").over(same).alias("lang_docs"),
        (F.min("source").over(same) == F.col("source")).alias("first"),
    )
    return counts.where(F.col("term").isNull() | (F.col("lang_docs") >= min_docs)).drop("lang_docs")


def share(n: Column | str, total: str) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * V)), in decimals; 1 where nothing is kept."""
    up = F.lit(SCALE).cast("decimal(10,0)") * (n + F.lit(SMOOTH)).cast("decimal(20,0)")
    down = (F.col(total) + SMOOTH * F.col("v")).cast("decimal(20,0)")
    return F.coalesce(F.call_function("div", up, F.nullif(down, F.lit(0).cast("decimal(20,0)"))), F.lit(0)) + 1


def sources(kept: DataFrame) -> DataFrame:
    """(lang, source, total, v, lang_total, postings, peers, zero) of every source of every language."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = kept.groupBy("lang").agg(
        F.sum((F.col("term").isNotNull() & F.col("first")).cast("long")).alias("v"), F.sum("n").alias("lang_total"), F.count("term").alias("postings"),
        F.sum(F.col("term").isNull().cast("long")).alias("peers"),
    )
    return own.join(whole, "lang").withColumn("zero", share(F.lit(0), "total"))


# --- differences

_SUMS = ["lang", "a", "b", "part"]


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one slab: (lang, a, b, part) for every two sources in both orders; the two parts add up to the slab's share in the sum."""
    slab = pa.Table.from_batches(batches)
    is_peer = pc.is_null(slab["term"])
    peers, cells = slab.filter(is_peer).sort_by("source"), slab.filter(pc.invert(is_peer))
    names, lang = peers["source"].combine_chunks(), peers["lang"][0].as_py()
    zero = peers["p"].to_numpy().astype(np.int64)
    src = pc.index_in(cells["source"], names).to_numpy().astype(np.int64)
    term = cells["term"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64) if cells.num_rows else src
    order = np.lexsort((src, term))
    src, term, p = src[order], term[order], cells["p"].to_numpy().astype(np.int64)[order]
    end = np.searchsorted(term, term, "right")  # of the postings of an entry's term
    n_terms = int(term[-1]) + 1 if len(term) else 0
    rows = np.argsort(src, kind="stable")
    bounds = np.searchsorted(src[rows], np.arange(len(names) + 1))
    for a in range(len(names)):
        own = rows[bounds[a] : bounds[a + 1]]
        apart = np.abs(zero[a] - zero)
        acc = np.zeros(len(names), np.int64)
        acc[a + 1 :] = n_terms * apart[a + 1 :]
        # a's own terms against the zero shares of all
        mine = np.sort(p[own])
        sums = np.concatenate(([0], np.cumsum(mine)))
        under = np.searchsorted(mine, zero)
        acc += 2 * (zero * under - sums[under]) + sums[-1] - zero * len(mine) - apart * len(mine)
        # a's terms scattered over the later peers of their postings
        counts = end[own] - own - 1
        cut = np.cumsum(counts) // PAIRS
        for c in np.unique(cut):
            e, k = own[cut == c], counts[cut == c]
            there = np.repeat(e + 1 - (np.cumsum(k) - k), k) + np.arange(k.sum())
            b, q, pa_ = src[there], p[there], np.repeat(p[e], k)
            np.add.at(acc, b, np.abs(pa_ - q) - np.abs(pa_ - zero[b]) - np.abs(zero[a] - q) + apart[b])
        others = np.flatnonzero(np.arange(len(names)) != a)
        if len(others):
            one = [pa.array([x] * len(others), pa.string()) for x in (lang, names[a].as_py())]
            yield pa.record_batch([*one, names.take(pa.array(others)), pa.array(acc[others])], _SUMS)


def pair_values(kept: DataFrame, dims: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, in both orders."""
    cells = F.least(F.greatest(F.col("peers") * F.col("peers"), F.lit(least)), F.lit(most))
    slabs = F.ceil(F.col("postings") / cells).cast("int")
    peers = dims.select("lang", F.explode(F.sequence(F.lit(0), F.greatest(slabs, F.lit(1)) - 1)).alias("slab"), "source", F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"))
    own = kept.where("term is not null").join(dims, ["lang", "source"])
    own = own.select("lang", F.pmod(F.xxhash64("term"), slabs).cast("int").alias("slab"), "source", "term", share(F.col("n"), "total").alias("p"))
    parts = peers.unionByName(own).groupBy("lang", "slab").applyInArrow(_differences, "lang string, a string, b string, part long")
    sums = parts.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("part").alias("value"))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return sums.select("lang", F.explode(both).alias("x"), "value").select("lang", "x.source", "x.item", "value")


def ranked(df: DataFrame) -> DataFrame:
    """rank: from 1 in each source, by value descending and item ascending."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def term_values(kept: DataFrame, dims: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a source has more of than its language."""
    own = kept.where("term is not null and n > 0").join(dims, ["lang", "source"])
    over = share(F.col("n"), "total") - share(F.col("lang_n"), "lang_total")
    return own.select("lang", "source", F.col("term").alias("item"), over.alias("value")).where("value > 0")


def audit(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Ranked differences of the sources of a language (part pair) and the `top` terms of each source (part term)."""
    kept = materialize(kept_counts(df, lang, source, text, min_docs), "divergence-counts")
    dims = materialize(sources(kept), "divergence-sources")
    pairs = ranked(pair_values(kept, dims, least, most)).withColumn("part", F.lit("pair"))
    best = ranked(term_values(kept, dims)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(best).select("lang", "source", "part", "item", "value", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(*) >= {MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, sum(t.n)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
  1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {SMOOTH})) // (g.total + {SMOOTH} * l.v) AS p,
  1 + ({SCALE}::HUGEINT * (k.n + {SMOOTH})) // (l.total + {SMOOTH} * l.v) AS q
  FROM g JOIN l ON g.lang = l.lang JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= {TOP}"""
