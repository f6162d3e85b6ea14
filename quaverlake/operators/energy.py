"""Learned energy maps: what each of 96 equal parts of an item sounded like, peaks held over all plays."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming import Spaced, over_table

BINS = 96
#: Samples that make a bin known, and the share of known bins that structure needs.
KNOWN, COVERAGE = 2, 0.5
TIERS = (0.40, 0.72)
SHORT = 4
SAME_LENGTH_MS = 2000


def heat_map(samples: DataFrame, key: str, position: str = "pos_ms", duration: str = "duration_ms") -> DataFrame:
    """(key, bin, level, bass, treble, n): peaks of the samples in each bin. Partial peaks are taken before the shuffle."""
    place = F.least(F.lit(BINS - 1), F.floor(F.col(position) / F.col(duration) * BINS)).cast("int")
    rows = samples.where((F.col(duration) > 0) & (F.col(position) >= 0)).withColumn("bin", place)
    peaks = [F.max(c).alias(c) for c in ("level", "bass", "treble")]
    return rows.groupBy(key, "bin").agg(*peaks, F.count("*").alias("n"))


def merge_maps(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Peaks of both; an old map counts only if its duration_ms is that of the new one within 2 s."""
    length = new.groupBy(key).agg(F.max("duration_ms").alias("__d"))
    fit = old.join(length, key, "left").where(F.col("__d").isNull() | (F.abs(F.col("duration_ms") - F.col("__d")) <= SAME_LENGTH_MS)).drop("__d")
    both = fit.unionByName(new)
    return both.groupBy(key, "bin").agg(F.max("duration_ms").alias("duration_ms"), *[F.max(c).alias(c) for c in ("level", "bass", "treble")], F.sum("n").alias("n"))


def cells(maps: DataFrame, key: str) -> DataFrame:
    """Bands over the map's loudest level, at most 1, and whether a bin is known."""
    top = F.max("level").over(Window.partitionBy(key))
    scaled = {c: F.when(top > 0, F.least(F.lit(1.0), F.col(c) / top)).otherwise(F.lit(0.0)) for c in ("level", "bass", "treble")}
    return maps.withColumn("known", F.col("n") >= KNOWN).withColumns(scaled)


def coverage(maps: DataFrame, key: str) -> DataFrame:
    return maps.groupBy(key).agg((F.count_if(F.col("n") >= KNOWN) / BINS).alias("coverage"))


def lookahead(scaled: DataFrame, key: str, ahead: int) -> DataFrame:
    """From the start of each known bin: the loudest known bin among the next `ahead`, the first of equals.

    A frame over bin numbers, no join: gaps in a map are gaps in the frame.
    """
    w = Window.partitionBy(key).orderBy("bin").rangeBetween(1, ahead)
    best = F.max(F.when(F.col("known") & (F.col("level") > 0), F.struct(F.col("level").alias("peak"), (-F.col("bin")).alias("neg")))).over(w)
    out = scaled.withColumn("b", best).where("known")
    steps = -F.col("b.neg") - F.col("bin")
    rise = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("b.peak") - F.col("level")))
    return out.select(key, "bin", "level", F.coalesce("b.peak", F.lit(0.0)).alias("peak"), F.coalesce(rise, F.lit(0.0)).alias("rise"), F.coalesce(1 - steps / ahead, F.lit(0.0)).alias("imminence"))


def _tier(level):
    return F.when(level >= TIERS[1], 2).when(level >= TIERS[0], 1).otherwise(0)


def _named(runs: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("first_bin")
    following, place = F.lead("tier").over(w), F.row_number().over(w)
    last = F.lead("first_bin").over(w).isNull()
    kind = F.when(F.col("tier") == 2, "drop").when(F.col("tier") == 1, F.when(following == 2, "build").otherwise("verse"))
    return runs.withColumn("kind", kind.when(place == 1, "intro").when(last, "outro").otherwise("break"))


def smoothed(scaled: DataFrame, key: str) -> DataFrame:
    """(key, bin, smooth) of all 96 bins: mean of the known bins among a bin and its neighbours, 0 where none is known."""
    known = scaled.where("known").select(key, "bin", "level")
    spread = known.select(key, F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"), "level").where(F.col("bin").between(0, BINS - 1))
    mean = spread.groupBy(key, "bin").agg(F.avg("level").alias("smooth"))
    every = scaled.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
    return every.join(mean, [key, "bin"], "left").fillna(0.0, ["smooth"])


def tier_sections(scaled: DataFrame, key: str) -> DataFrame:
    """Sections by energy tier of the maps known well enough; runs under 4 bins go to the longer neighbour.

    Absorbing runs goes right to left over what it has changed before, so each map (96 rows) is one small group.
    """
    enough = scaled.groupBy(key).agg((F.count_if("known") / BINS).alias("c")).where(F.col("c") >= COVERAGE).select(key)
    flat = smoothed(scaled.join(enough, key, "left_semi"), key).withColumn("tier", _tier(F.col("smooth")))
    kind = flat.schema[key].dataType.simpleString()

    def absorb(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bin")
        runs: list[list[int]] = []
        for b, t in zip(part["bin"], part["tier"]):
            if runs and runs[-1][2] == t:
                runs[-1][1] = b
            else:
                runs.append([b, b, t])
        k = len(runs) - 1
        while k >= 0 and len(runs) > 1:
            a, b, _ = runs[k]
            if b - a + 1 < SHORT:
                sides = [(runs[i][1] - runs[i][0], -i, i) for i in (k - 1, k + 1) if 0 <= i < len(runs)]
                host = runs[max(sides)[2]]
                host[0], host[1] = min(host[0], a), max(host[1], b)
                del runs[k]
            k -= 1
        level = part.set_index("bin")["smooth"]
        return pd.DataFrame([(part[key].iloc[0], a, b, t, float(level[a:b].mean())) for a, b, t in runs], columns=[key, "first_bin", "last_bin", "tier", "level"])

    runs = flat.groupBy(key).applyInPandas(absorb, f"{key} {kind}, first_bin int, last_bin int, tier int, level double")
    return _named(runs, key)


def measured_sections(scaled: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """Sections that begin at the bins in `starts` (key, first_bin), each with the tier of its mean."""
    w = Window.partitionBy(key).orderBy("first_bin")
    runs = starts.distinct().withColumn("last_bin", F.coalesce(F.lead("first_bin").over(w) - 1, F.lit(BINS - 1)))
    flat = smoothed(scaled, key)
    at = runs.select(key, "first_bin", "last_bin", F.explode(F.sequence("first_bin", "last_bin")).alias("bin"))
    out = at.join(flat, [key, "bin"]).groupBy(key, "first_bin", "last_bin").agg(F.avg("smooth").alias("level"))
    return _named(out.withColumn("tier", _tier(F.round("level", 9))), key)


#: Drops and kicks: least distance in ms, least strength, and how many of each are kept.
DROP_GAP, KICK_GAP, KICK_LEAST, DROPS, KICKS = 1500, 110, 0.5, 400, 4000


def beat_map(frames: DataFrame, key: str) -> DataFrame:
    """frames (key, pos_ms, drop boolean, kick double) -> (key, kind, t, v); items without a drop and under 8 kicks go.

    Keeping a distance depends on what was kept before: a fold over an item's sorted candidates, which are filtered first.
    Of frames at the same time the weaker kick comes first. The last 400 drops and 4,000 kicks of an item are kept.
    """
    def marks(kind: str, test: Column, strength: Column, gap: int, most: int) -> DataFrame:
        candidates = frames.where(test & F.col("pos_ms").isNotNull()).select(key, F.col("pos_ms").cast("double").alias("t"), strength.cast("double").alias("v"))
        latest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("t")))
        return over_table(candidates, Spaced(gap), key).withColumn("n", latest).where(F.col("n") <= most).select(key, F.lit(kind).alias("kind"), "t", "v")

    found = marks("drop", F.col("drop"), F.lit(1.0), DROP_GAP, DROPS).unionByName(marks("kick", F.col("kick") > KICK_LEAST, F.col("kick"), KICK_GAP, KICKS))
    counts = Window.partitionBy(key)
    told = (F.count_if(F.col("kind") == "drop").over(counts) > 0) | (F.count_if(F.col("kind") == "kick").over(counts) >= 8)
    return found.withColumn("told", told).where("told").drop("told")
