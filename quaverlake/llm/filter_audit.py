"""What filters do to each other in every order: Lehmer-rank difference arrays.

Each row gets a mask of the filters that it fails. Orders of k filters are the k! permutations in
lexicographic order; the rank of one is the number that its Lehmer digits spell. A mask goes at the first
filter of an order that it holds, so it goes at step s by filter f exactly where the order begins with s - 1
filters that it doesn't hold, and then f. Orders with one beginning are an interval of ranks, so each mask
adds its counts at the ends of a few intervals, and sums along the ranks give what every step of every
order removes. Rows are only counted: by mask and part, where Spark does the work, and then 2^k rows a part.

Filters: A: under 100 words; B: under 80 % distinct words; C: over 10 % capital letters; D: holds any of
#$%&*|; E: the text of any smaller key, removed or not, in the whole table.

Defined cases: a null text or part is empty; an empty text fails A only (and E); a null key is no smaller
one and has none; repeated rows of one key are no copies of each other and each count; a key with several
labels has quality or toxicity if one of them says so, and a key without has neither; labels of null keys
are left out; extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, null_safe_text, read_table

LETTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
CAPITALS_PERCENT = 10
SYMBOLS = b"#$%&*|"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CONTINUATION = bytes(range(0x80, 0xC0))
_COUNTS = ["n", "good", "toxic"]


# --- masks

def own_mask(text: bytes) -> int:
    """Bits of the filters A to D that look at one text."""
    w = text.split()  # of bytes: between ASCII white space
    points = len(text.translate(None, _CONTINUATION))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    fails = (
        len(w) < MIN_WORDS,
        100 * len(set(w)) < DISTINCT_PERCENT * len(w),
        100 * capitals > CAPITALS_PERCENT * points,
        len(text.translate(None, SYMBOLS)) < len(text),
    )
    return sum(1 << k for k, f in enumerate(fails) if f)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_buffer().to_pybytes() for t in batch.column(2).cast(pa.binary())]
        digest = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        yield pa.record_batch([batch.column(0), batch.column(1), digest, pa.array([own_mask(t) for t in texts], pa.int32())], ["key", "part", "digest", "mask"])


def masks(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic) of every row; bit k of mask is set if the row fails filter k."""
    own = df.select(F.col(key).cast("long").alias("key"), null_safe_text(part).alias("part"), null_safe_text(text).alias("body"))
    own = own.mapInArrow(_own, "key long, part string, digest binary, mask int")
    marks = (
        labels.select(F.col(key).cast("long").alias("key"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
        .where("key is not null")
        .groupBy("key")
        .agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    )
    rows = materialize(own.join(marks, "key", "left"), "audit-rows")
    # the first of each text is met by text and key, so that a text of many rows is no hot key
    firsts = rows.groupBy("digest").agg(F.min("key").alias("key")).where("key is not null").withColumn("first", F.lit(True))
    copy = F.col("key").isNotNull() & F.col("first").isNull()
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long").alias(c)
    return rows.join(firsts, ["digest", "key"], "left").select("part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"), flag("good"), flag("toxic"))


# --- orders

@lru_cache
def intervals(mask: int, k: int) -> tuple[tuple[int, int, int], ...]:
    """(step from 0, first rank, end rank) of all orders in which a mask of k filters goes at that step."""
    out = []

    def begin(free: tuple[int, ...], step: int, rank: int) -> None:
        width = factorial(k - 1 - step)
        for digit, f in enumerate(free):  # the Lehmer digit: how many free filters stand before f
            low = rank + digit * width
            if mask >> f & 1:
                out.append((step, low, low + width))
            elif step < k - 1:
                begin(free[:digit] + free[digit + 1 :], step + 1, low)

    begin(tuple(range(k)), 0, 0)
    return tuple(out)


def interactions(counts: pd.DataFrame, letters: str = LETTERS) -> pd.DataFrame:
    """counts: (mask, n, good, toxic) of one part, each mask once. A row for each order and step."""
    k = len(letters)
    ends = np.zeros((3, k, factorial(k) + 1), np.int64)
    for mask, *own in counts[["mask", *_COUNTS]].itertuples(index=False):
        for step, low, high in intervals(mask, k):
            ends[:, step, low] += own
            ends[:, step, high] -= own
    removed, good, toxic = np.cumsum(ends, axis=2)[:, :, :-1].transpose(0, 2, 1)  # each: ranks x steps
    orders = np.array(list(permutations(range(k))))
    mask, n = counts["mask"].to_numpy(), counts["n"].to_numpy()
    fails = np.array([n[mask >> f & 1 == 1].sum() for f in range(k)])
    alone = np.array([n[mask == 1 << f].sum() for f in range(k)])
    shares = np.zeros(k, np.int64)
    np.add.at(shares, orders.ravel(), removed.ravel())
    return pd.DataFrame({
        "filter_order": np.repeat(["".join(letters[f] for f in o) for o in orders], k),
        "step": np.tile(np.arange(1, k + 1), len(orders)),
        "kept": (n.sum() - np.cumsum(removed, axis=1)).ravel(),
        "removed": removed.ravel(),
        "redundant": (fails[orders] - removed).ravel(),
        "unique_fails": alone[orders].ravel(),
        "good_lost": good.ravel(),
        "toxic_lost": toxic.ravel(),
        "shapley": shares[orders].ravel(),
    })


_RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(masked: DataFrame, letters: str = LETTERS) -> DataFrame:
    """masked: (part, mask, good, toxic) rows. A row for each part, order of the filters and step."""
    counts = masked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))

    def orders(own: pd.DataFrame) -> pd.DataFrame:  # at most 2^k rows
        out = interactions(own, letters)
        out.insert(0, "part", own["part"].iloc[0])
        return out

    return counts.groupBy("part").applyInPandas(orders, _RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(masks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS f FROM d),
m AS (SELECT part, doc_id, (len(w) < {MIN_WORDS})::INT
    + 2 * (100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITALS_PERCENT} * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > f, false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT i, 1 << i AS bit, substr('{LETTERS}', i + 1, 1) AS c FROM (SELECT unnest(range(5))::INT AS i)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits,
  [0, a.bit, a.bit + b.bit, a.bit + b.bit + c.bit, a.bit + b.bit + c.bit + d.bit] AS earlier
  FROM x a, x b, x c, x d, x e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, s::INT AS step, bits[s] AS bit, earlier[s] AS earlier FROM o, range(1, 6) AS r(s)),
r AS (SELECT part, filter_order, step, bit, mask, n, good, toxic, mask & bit > 0 AS fails, mask & earlier > 0 AS gone FROM s, c),
g AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept,
  coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM g"""
