"""Colours that stand out among an image's pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Least opacity, least and greatest mean of the channels, and how many colours there are.
OPAQUE, DARKEST, LIGHTEST, COLOURS = 128, 28, 238, 4


def palette(pixels: DataFrame, key: str) -> DataFrame:
    """pixels (key, r, g, b, a: 0 to 255) -> (key, rank from 0, colour as #rrggbb, score).

    Colours are counted in 8 x 8 x 8 cells before the shuffle; a cell's score is its count, more
    where it is vivid. The best 4 stay, of equal scores the lower cell; keys of one cell give no rows.
    """
    r, g, b = (F.col(c).cast("int") for c in "rgb")
    top, low, mean = F.greatest(r, g, b), F.least(r, g, b), (r + g + b) / 3
    shown = pixels.where((F.col("a") >= OPAQUE) & (mean >= DARKEST) & (mean <= LIGHTEST))
    cell = F.shiftright(r, 5) * 64 + F.shiftright(g, 5) * 8 + F.shiftright(b, 5)
    vivid = F.when(top == 0, 0.0).otherwise((top - low) / top)
    cells = shown.groupBy(key, cell.alias("cell")).agg(F.count("*").alias("n"), F.sum(vivid).alias("vivid"), *[F.sum(F.col(c).cast("long")).alias(c) for c in "rgb"])
    cells = cells.withColumn("score", F.round(F.col("n") * 0.35 + F.col("vivid"), 9))
    best = Window.partitionBy(key).orderBy(F.desc("score"), "cell")
    cells = cells.withColumns({"rank": F.row_number().over(best) - 1, "cells": F.count("*").over(Window.partitionBy(key))})
    byte = lambda c: F.lpad(F.lower(F.hex(F.floor(F.col(c) / F.col("n") + 0.5))), 2, "0")
    colour = F.concat(F.lit("#"), byte("r"), byte("g"), byte("b"))
    return cells.where((F.col("cells") >= 2) & (F.col("rank") < COLOURS)).select(key, "rank", colour.alias("colour"), "score")
