"""Positions against timelines: the latest entry before a position, and the interval around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_before(points: DataFrame, timeline: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """points plus `values` of the last timeline row at or before `at`; nulls where there is none.

    Union, one shuffle by key and one sort; no pair is ever formed. Of timeline rows at the
    same place that of the greatest values counts.
    """
    known = F.struct(*(F.col(v) for v in values))
    left = points.select(F.struct(*points.columns).alias("__row"), *by, at, F.lit(1).alias("__side"), F.lit(None).cast(timeline.select(known.alias("k")).schema["k"].dataType).alias("__v"))
    right = timeline.select(F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), *by, at, F.lit(0).alias("__side"), known.alias("__v"))
    w = Window.partitionBy(*by).orderBy(at, "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("__got", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return both.select("__row.*", *[F.col(f"__got.{v}").alias(v) for v in values])


def interval_at(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, values: list[str]) -> DataFrame:
    """points plus `values` of the half-open interval that holds them; the intervals of a key don't overlap."""
    line = intervals.withColumn(at, F.col(start))
    got = latest_before(points, line, by, at, [start, end, *values])
    inside = F.col(at) < F.col(end)
    return got.select(*points.columns, *[F.when(inside, F.col(v)).alias(v) for v in (start, end, *values)])
