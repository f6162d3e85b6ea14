"""Play histories: repeats, prediction, change detection, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY = 500


def collapse_repeats(df: DataFrame, owner: str, key: str, order: list[str], keep: int = HISTORY) -> DataFrame:
    """df without rows that repeat their predecessor, and of the rest the last `keep` per owner."""
    w = Window.partitionBy(owner).orderBy(*order)
    out = df.withColumn("__before", F.lag(F.struct(key)).over(w)).where(~F.struct(key).eqNullSafe(F.col("__before"))).drop("__before")
    back = Window.partitionBy(owner).orderBy(*(F.desc(c) for c in order))
    return out.withColumn("__n", F.row_number().over(back)).where(F.col("__n") <= keep).drop("__n")


def next_item(history: DataFrame, owner: str, key: str, order: list[str], least: int = 2) -> DataFrame:
    """Per (owner, key): the most frequent successor with its count; of equal counts the latest. One shuffle, by owner."""
    w = Window.partitionBy(owner).orderBy(*order)
    pairs = history.select(owner, key, F.lead(key).over(w).alias("next_key"), F.row_number().over(w).alias("at"))
    counts = pairs.where("next_key is not null").groupBy(owner, key, "next_key").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    best = Window.partitionBy(owner, key).orderBy(F.desc("n"), F.desc("last"))
    return counts.where(F.col("n") >= least).withColumn("r", F.row_number().over(best)).where("r = 1").drop("r", "last")


def changes(df: DataFrame, owner: str, key: str, order: list[str]) -> DataFrame:
    """The rows whose key differs from the row before."""
    w = Window.partitionBy(owner).orderBy(*order)
    return df.withColumn("__b", F.lag(F.struct(key)).over(w)).where(~F.struct(key).eqNullSafe(F.col("__b"))).drop("__b")


def speculative(history: DataFrame, predicted: DataFrame, cache: DataFrame, owner: str, key: str, order: list[str]) -> DataFrame:
    """Predicted next items of each owner's latest play that the cache doesn't hold."""
    last = history.groupBy(owner).agg(F.max_by(key, F.struct(*order)).alias(key))
    wanted = last.join(predicted, [owner, key])
    return wanted.join(cache.select(F.col(owner), F.col(key).alias("next_key")), [owner, "next_key"], "left_anti")


def counters(df: DataFrame, day: str, page: str) -> DataFrame:
    """Counts in total, by day and by page, in one pass."""
    return df.groupingSets([[], [day], [page]], day, page).agg(F.count("*").alias("n"))
