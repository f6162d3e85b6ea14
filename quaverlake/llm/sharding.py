"""Rendezvous hashing of stable record keys over weighted shards (native).

A record goes to the shard of highest score, -weight / ln(u), where u is a uniform number
that the key and the shard's number decide. One more shard only takes the records on which
it scores highest; no record moves between old shards.

Defined cases: a null key is the empty key, a null text has size 1 and CRC 0, equal keys
share a shard, rows equal in key, size and CRC get neighbouring slots, an empty table gives
no rows. Only the named columns are read, so further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import null_safe_text, read_table

#: Slots of equal rows that are listed at once.
BLOCK = 1 << 14
SHARDS = 16
#: Slots are counted within (shard, bucket) first: no task sorts a whole shard.
SLOT_BUCKETS_HEX = 3


def _uniform(key: Column, shard: int) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f"#{shard}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def _score(key: Column, shard: int, weight: float) -> Column:
    if not weight > 0:
        raise ValueError("a shard's weight must be positive")
    return F.struct((F.lit(-float(weight)) / F.log(_uniform(key, shard))).alias("s"), F.lit(-shard).alias("k"))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The number of the shard that the key goes to; ties go to the smaller number."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    scores = [_score(key, k, w) for k, w in enumerate(weights)]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["k"]).cast("int")


def assign_shards(df: DataFrame, key: str = "doc_id", weights: list[float] | None = None, grown_weight: float = 1.0, shard_col: str = "shard", grown_col: str = "grown_shard") -> DataFrame:
    """df with its shard now and after one more shard of grown_weight. No shuffle; columns of those names are replaced."""
    weights = weights or [1.0] * SHARDS
    return df.withColumns({shard_col: rendezvous(F.col(key), weights), grown_col: rendezvous(F.col(key), [*weights, grown_weight])})


def write_shards(df: DataFrame, path: str, shard_col: str = "shard", files_per_shard: int = 1) -> None:
    """One folder per shard. Rows are dealt by shard and a salt, so that files_per_shard tasks share a shard."""
    salted = df.repartition(F.col(shard_col), F.pmod(F.xxhash64(*df.columns), F.lit(files_per_shard)))
    salted.write.partitionBy(shard_col).parquet(path)


def shard_manifest(df: DataFrame, key: str = "doc_id", text: str = "text", weights: list[float] | None = None) -> DataFrame:
    """Per row: key, size, text_crc32, shard, slot, grown_shard.

    Equal rows are counted before the shuffle; a running sum of counts within each of the
    4096 buckets of a shard plus the bucket's offset gives the slots.
    """
    body = null_safe_text(text)
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    same = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    placed = assign_shards(same, "doc_id", weights).withColumn(
        "bucket", F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("#slot"))), 1, SLOT_BUCKETS_HEX)
    )
    by_bucket = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select("shard", "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0)))
    # at most 16 x 4096 rows of offsets, whatever the input
    out = first.join(F.broadcast(offsets), ["shard", "bucket"])
    # equal rows are made again in blocks, so that no array holds all of their slots
    low, n = F.col("offset") + F.col("first"), F.col("n")
    out = out.select("*", F.explode(F.sequence(low, low + n - 1, F.lit(BLOCK).cast("long"))).alias("block"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.explode(F.sequence("block", F.least(F.col("block") + BLOCK, low + n) - 1)).alias("slot"),
        "grown_shard",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_manifest(read_table(spark, sf_dir, "documents"))


def _sql() -> str:
    scores = ", ".join(f"('0x' || substr(md5(k || '#{s}'), 1, 13))::BIGINT" for s in range(SHARDS + 1))
    return f"""
WITH RECURSIVE poly AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(0, 8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
    FROM (SELECT unnest(range(0, 256)) AS i))),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, k, length(h) // 2 + 1 AS size,
  xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
      lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295), 4294967295) AS text_crc32,
  [{scores}] AS s, substr(md5(k || '#slot'), 1, {SLOT_BUCKETS_HEX}) AS bucket
  FROM d, poly),
p AS (SELECT *, list_position(s[1:{SHARDS}], list_max(s[1:{SHARDS}])) - 1 AS shard, list_position(s, list_max(s)) - 1 AS grown FROM c)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot,
  grown::INTEGER AS grown_shard
FROM p"""


SQL = _sql()
