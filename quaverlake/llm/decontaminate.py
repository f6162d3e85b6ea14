"""Benchmark decontamination: training texts are scanned for windows of benchmark items.

Words are lower-cased (A-Z) runs outside ASCII punctuation and space. A window is 13
consecutive words of an item, or all words of a shorter one. The windows' word ids and
sorted hashes are broadcast; a document's words are mapped to ids, positions where all 13
words are known are hashed, hits are verified word by word, and the words inside any
occurrence are counted. One pass over the documents and no shuffle.

Only `block_bytes` of benchmark text are broadcast at once. A larger benchmark is cut into
blocks by a hash of the item, one pass each; what earlier passes hit travels with the rows
through the shared folder.

Defined cases: null and empty texts have no words, repeated rows each get their result,
items of the same id count once, a null item_id is the text `null`, an empty benchmark hits
nothing. Further columns of the documents are kept; those named like results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW, materialize, packed, read_table, unpacked

WINDOW = 13
BLOCK_BYTES = 16 << 20
#: A document is contaminated if this many times its hit words reach its words.
SHARE = 20

#: Pairs of a document's and the items' windows that are compared at once.
PAIRS = 1 << 20

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def _hashes(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(starts), np.uint64)
    for k in range(n):
        h = h * _PRIME + ids[starts + k].astype(np.uint64)
    return h


class Windows:
    """The windows of a block of items: the word ids of all texts in one array, and per length the windows in order of their hashes.

    About 20 bytes a window; equal windows of an item are kept once.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        texts, spans, at = [np.zeros(0, np.int32)], {}, 0
        for k, (_, text) in enumerate(items):
            own = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words(text)]
            if n := min(window, len(own)):
                spans.setdefault(n, []).append((k, at, len(own) - n + 1))
            texts.append(np.array(own, np.int32))
            at += len(own)
        self.ids = np.concatenate(texts)
        self.tables = {}
        for n, found in spans.items():
            start = np.concatenate([np.arange(a, a + count, dtype=np.int32) for _, a, count in found])
            owner = np.concatenate([np.full(count, k, np.int32) for k, _, count in found])
            h = _hashes(self.ids, start, n)
            order = np.lexsort((owner, h))
            h, start, owner = h[order], start[order], owner[order]
            again = np.concatenate(([False], (h[1:] == h[:-1]) & (owner[1:] == owner[:-1]) & self._equal(self.ids, start[1:], start[:-1], n)))
            self.tables[n] = h[~again], start[~again], owner[~again]

    def _equal(self, ids: np.ndarray, mine: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
        """Which windows of `ids` at `mine` are those of the items at `other`, word by word."""
        same = np.ones(len(mine), bool)
        for k in range(n):
            same &= ids[mine + k] == self.ids[other + k]
        return same

    def find(self, w: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words are hit (None: none) and by which items."""
        if not w or not self.tables:
            return None, set()
        ids = np.fromiter(map(self.vocabulary.get, w, [0] * len(w)), np.int32, len(w))
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        hit, items = None, set()
        for n, (hashes, start, owner) in self.tables.items():
            if len(ids) < n:
                continue
            places = np.flatnonzero(unknown[n:] == unknown[: len(unknown) - n])
            if not len(places):
                continue
            h = _hashes(ids, places, n)
            low = np.searchsorted(hashes, h)
            met = hashes[np.minimum(low, len(hashes) - 1)] == h
            places, low, count = places[met], low[met], np.searchsorted(hashes, h[met], "right") - low[met]
            cut = np.cumsum(count) // PAIRS
            for c in np.unique(cut):
                p, a, m = places[cut == c], low[cut == c], count[cut == c]
                entry = np.repeat(a - (np.cumsum(m) - m), m) + np.arange(m.sum())
                p = np.repeat(p, m)
                same = self._equal(ids, p, start[entry], n)
                if same.any():
                    hit = np.zeros(len(ids) + 1, np.int64) if hit is None else hit
                    p = np.unique(p[same])
                    hit[p] += 1
                    hit[p + n] -= 1
                    items.update(self.names[o] for o in np.unique(owner[entry[same]]))
        return (None, items) if hit is None else (np.cumsum(hit[:-1]) > 0, items)


_STATE = T.StructType([T.StructField("__n", T.LongType()), T.StructField("__covered", T.LongType()), T.StructField("__hit", T.BinaryType()), T.StructField("__items", T.ArrayType(T.StringType()))])


def scan(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, item_text: str = "text") -> DataFrame:
    """df plus __n (words), __covered (hit words), __hit (packed bits of hit words, null if none) and __items (hitting items)."""
    spark = df.sparkSession
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("body")).distinct()
    total = items.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    plain = [f.name for f in df.schema]
    schema = T.StructType([*df.schema, *_STATE])
    now = df.select("*", F.lit(None).cast("long").alias("__n"), F.lit(0).cast("long").alias("__covered"), F.lit(None).cast("binary").alias("__hit"), F.array().cast("array<string>").alias("__items"))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == b).collect()  # at most about block_bytes
        table = spark.sparkContext.broadcast(Windows([(r[0], r[1].encode()) for r in own], window))

        def run(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts, covered, hits, found = [], [], [], []
                body = batch.column(plain.index(text)).cast(pa.binary())
                for t, c, h, i in zip(body, batch.column("__covered").to_pylist(), batch.column("__hit"), batch.column("__items").to_pylist()):
                    w = words(t.as_buffer().to_pybytes()) if t.is_valid else []
                    mask, own = table.value.find(w)
                    if h.is_valid and mask is not None:
                        mask = mask | (np.unpackbits(np.frombuffer(h.as_py(), np.uint8), count=len(w)) > 0)
                    counts.append(len(w))
                    covered.append(c if mask is None else int(mask.sum()))
                    hits.append(h.as_py() if mask is None else np.packbits(mask).tobytes())
                    found.append(sorted(own.union(i or [])))
                new = {"__n": pa.array(counts, pa.int64()), "__covered": pa.array(covered, pa.int64()), "__hit": pa.array(hits, pa.binary()), "__items": pa.array(found, pa.list_(pa.string()))}
                yield pa.record_batch([new.get(n, batch.column(k)) for k, n in enumerate([*plain, *new])], [*plain, *new])

        now = now.mapInArrow(run, schema)
        if blocks > 1:
            now = materialize(now, "decontaminate")
    return now


def judge(df: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """df plus n_words, n_hit, n_items, items and contaminated; columns of these names are replaced."""
    found = scan(packed(df, text, body=F.col(text)), benchmark, "body", **options)
    hit = (F.col("__covered") > 0) & (SHARE * F.col("__covered") >= F.col("__n"))
    results = {"n_words": F.col("__n"), "n_hit": F.col("__covered"), "n_items": F.size("__items").cast("long"), "items": F.col("__items"), "contaminated": hit}
    columns = [c for c in df.columns if c not in results]
    return unpacked(found, [*columns, *results], **results, **{text: F.col("body")})


def remove_documents(df: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """df without its contaminated rows."""
    judged = judge(packed(df, text, body=F.col(text)), benchmark, text="body", **options)
    return unpacked(judged.where(~F.col("contaminated")), df.columns, **{text: F.col("body")})


def remove_spans(df: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """df with every hit word, and what stands between hit words, cut out of its texts."""
    names = [f.name for f in df.schema]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, h in zip(batch.column(names.index(text)).cast(pa.binary()), batch.column(len(names))):
                body = t.as_buffer().to_pybytes() if t.is_valid else None
                if body is not None and h.is_valid:
                    is_word = np.frombuffer(body.translate(_WORD_BYTES), np.uint8) != 0x20
                    begin = np.flatnonzero(np.diff(is_word.astype(np.int8), prepend=0) == 1)
                    end = np.flatnonzero(np.diff(is_word.astype(np.int8), append=0) == -1) + 1
                    hit = np.unpackbits(np.frombuffer(h.as_py(), np.uint8), count=len(begin)) > 0
                    first = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])))
                    last = np.flatnonzero(hit & ~np.concatenate((hit[1:], [False])))
                    edges = [0, *(x for a, z in zip(begin[first], end[last]) for x in (a, z)), len(body)]
                    body = b"".join(body[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                out.append(None if body is None else body.decode())
            yield pa.record_batch([pa.array(out, pa.string()) if n == text else batch.column(n) for n in names], names)

    found = scan(packed(df, text, body=F.col(text)), benchmark, "body", **options)
    columns = [F.col("body").alias(text) if n == text else F.col(ROW).getField(n).alias(n) for n in names]
    own_hit = next(n for k in range(len(names) + 1) if (n := f"hit_{k}") not in names)
    return found.select(*columns, F.col("__hit").alias(own_hit)).mapInArrow(cut, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, read_table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), "contaminated")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, {_WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS g
  FROM b, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS x(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS x(i)),
hits AS (SELECT r, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + n)) AS y(k) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)"""
