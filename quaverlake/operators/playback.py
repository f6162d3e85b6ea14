"""What a stored map fires while an item plays, and where the beats of a known period fall."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A build-up grows over this long before a drop; a longer step, or one back, is a jump that fires nothing.
LEAD_MS, JUMP_MS = 1800, 2000
LEAST_ONSETS = 8


#: Ranges of marks are met by two runs of a power of two; longer ones are cut.
RUNS = 10


def _strongest(ranges: DataFrame, kicks: DataFrame, by: str) -> DataFrame:
    """ranges (by, lo, hi), kicks (by, n from 1 in order, kick) -> (by, lo, hi, kick): the strongest of those numbered lo + 1 to hi."""
    w, best = Window.partitionBy(by).orderBy("n"), F.col("kick")
    runs = kicks.withColumn("m0", best)
    for j in range(1, RUNS + 1):
        runs = runs.withColumn(f"m{j}", F.greatest(f"m{j - 1}", F.lead(f"m{j - 1}", 2 ** (j - 1)).over(w)))
    runs = runs.select(F.col(by).alias("__k"), F.col("n").alias("__n"), F.posexplode(F.array(*[f"m{j}" for j in range(RUNS + 1)])).alias("__j", "__m"))
    cut = ranges.withColumn("__a", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(2**RUNS).cast("long"))))
    cut = cut.withColumn("__size", F.least(F.col("hi") - F.col("__a"), F.lit(2**RUNS))).withColumn("j", F.length(F.bin("__size")) - 1)
    cut = cut.withColumn("s", F.explode(F.array(F.col("__a") + 1, F.col("__a") + F.col("__size") - F.pow(F.lit(2.0), F.col("j")).cast("long") + 1)))
    met = cut.join(runs, (F.col(by) == F.col("__k")) & (F.col("s") == F.col("__n")) & (F.col("j") == F.col("__j")))
    return met.groupBy(F.col(by).alias("__k"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi")).agg(F.max("__m").alias("kick"))


def fired(ticks: DataFrame, marks: DataFrame, by: str) -> DataFrame:
    """ticks (by, t, pos) and marks (by, at, kind drop or kick, strength) -> (by, t, pos, drop, kick, buildup), a row per tick.

    A tick meets the marks since the tick before, and the drops that come within the lead. No tick meets a mark by a join: at
    each place of a key the kicks so far are counted and the drops before and behind it are known, so a tick's drops are two
    comparisons and its kicks a range of numbers. Ticks without a position are left out; a jump, and the first tick, fire nothing.
    """
    steps = Window.partitionBy(by).orderBy("t", "pos")
    known = ticks.where("pos is not null")
    spots = marks.where(F.col("at").isNotNull() & F.col(by).isNotNull()).select(by, F.col("at").alias("x"), (F.col("kind") == "drop").alias("drop"), F.when(F.col("kind") == "kick", F.col("strength")).alias("kick"))
    asked = known.select(by, F.col("pos").alias("x")).distinct().select("*", F.lit(None).cast("boolean").alias("drop"), F.lit(None).cast("double").alias("kick"))
    places = spots.unionByName(asked).groupBy(by, "x").agg(F.max("drop").alias("drop"), F.max("kick").alias("kick"))
    dropped = F.when(F.col("drop"), F.col("x"))
    on = Window.partitionBy(by).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(by).orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)
    places = places.select(F.col(by).alias("__k"), F.col("x").alias("__x"), "kick", F.count("kick").over(on).alias("n"), F.last(dropped, ignorenulls=True).over(on).alias("last"), F.last(dropped, ignorenulls=True).over(back).alias("next"))
    kicks = places.where("kick is not null").select(F.col("__k").alias(by), "n", "kick")
    known = known.join(places, (F.col(by) == F.col("__k")) & (F.col("pos") == F.col("__x")), "left").withColumn("under", F.col("n") - F.col("kick").isNotNull().cast("long"))
    known = known.select(by, "t", "pos", "n", "under", "last", "next", F.lag("pos").over(steps).alias("before"), F.lag("n").over(steps).alias("n_before"), F.lag("under").over(steps).alias("under_before"))
    jump = F.col("before").isNull() | (F.col("pos") < F.col("before")) | (F.col("pos") - F.col("before") > JUMP_MS)
    known = known.withColumn("jump", jump)
    # behind a jump the mark at its very position is still to come
    known = known.withColumn("closed", F.coalesce(F.lag("jump").over(steps), F.lit(False)))
    drop = (F.col("last") > F.col("before")) | (F.col("closed") & (F.col("last") == F.col("before")))
    known = known.select(by, "t", "pos", "jump", F.when(F.col("closed"), F.col("under_before")).otherwise(F.col("n_before")).alias("lo"), F.col("n").alias("hi"),
        F.coalesce(drop & ~F.col("jump"), F.lit(False)).alias("drop"), F.when(~F.col("jump") & (F.col("next") - F.col("pos") < LEAD_MS), F.col("next") - F.col("pos")).alias("wait"))
    found = _strongest(known.where(~F.col("jump") & (F.col("hi") > F.col("lo"))).select(by, "lo", "hi").distinct(), kicks, by)
    met = known.join(found, (F.col(by) == F.col("__k")) & (F.col("lo") == F.col("__lo")) & (F.col("hi") == F.col("__hi")) & ~F.col("jump"), "left")
    same = Window.partitionBy(by, "t", "pos")  # equal ticks fire together
    all_of = lambda c: F.when(~F.col("jump"), c.over(same))
    return met.select(
        by, "t", "pos", F.coalesce(all_of(F.max("drop")), F.lit(False)).alias("drop"), F.greatest(F.coalesce(all_of(F.max("kick")), F.lit(0.0)), F.lit(0.0)).alias("kick"),
        F.coalesce(1 - all_of(F.min("wait")) / LEAD_MS, F.lit(0.0)).alias("buildup"),
    )


def phase(onsets: DataFrame, by: str, at: str, period_ms: float) -> DataFrame:
    """(by, phase_ms, confidence): the first beat at or behind the first onset, and how well the onsets fit the period.

    Sums of the onsets' angles, added up before the shuffle. Keys of under 8 onsets give no row, a period of 0 or less none at all.
    """
    turn = F.pmod(F.col(at).cast("double"), F.lit(float(period_ms))) / period_ms * (2 * pi)
    sums = onsets.where(F.col(at).isNotNull() & F.lit(period_ms > 0)).groupBy(by).agg(
        F.sum(F.cos(turn)).alias("re"), F.sum(F.sin(turn)).alias("im"), F.count("*").alias("n"), F.min(at).alias("first"))
    beat = F.pmod(F.atan2("im", "re") / (2 * pi) * period_ms - F.col("first"), F.lit(float(period_ms)))
    return sums.where(F.col("n") >= LEAST_ONSETS).select(by, (F.col("first") + beat).alias("phase_ms"), (F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) / F.col("n")).alias("confidence"))


def recorded(batches: DataFrame, by: str, order: list[str], most_s: int = 720) -> DataFrame:
    """batches (samples, rate) plus kept, total and full: a recording takes samples of its first batch's rate, up to `most_s` seconds of them.

    The machine `Recorder` as running sums: what is kept is what a clipped sum grows by.
    """
    w = Window.partitionBy(by).orderBy(*order)
    out = batches.withColumn("__own", F.first("rate").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    out = out.withColumn("__n", F.when(F.col("rate") == F.col("__own"), F.col("samples")).otherwise(0).cast("long"))
    out = out.withColumn("__sum", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    most = F.col("__own") * most_s
    out = out.withColumns({"total": F.least("__sum", most), "full": F.col("__sum") >= most, "kept": F.least("__sum", most) - F.least(F.col("__sum") - F.col("__n"), most)})
    return out.drop("__own", "__n", "__sum")


def record_slot(steps: DataFrame, by: str, order: list[str]) -> DataFrame:
    """steps (action, item) -> steps with (event, item) of what they do to the one slot of recordings: claimed, undone, kept, discarded.

    The machine `RecordSlot` as a window: after a start its item holds the slot, after anything else nobody does.
    """
    w = Window.partitionBy(by).orderBy(*order)
    held = F.when(F.lag("action").over(w) == "start", F.lag("item").over(w))
    starts = F.col("action") == "start"
    told = lambda when, event, item: F.when(when, F.struct(F.lit(event).alias("event"), item.alias("item")))
    had = F.col("__held").isNotNull()
    new = starts & ~F.col("__held").eqNullSafe(F.col("item"))
    every = F.array(
        told(new & had, "undone", F.col("__held")), told(new, "claimed", F.col("item")),
        told(~starts & had & (F.col("action") == "flush"), "kept", F.col("__held")), told(~starts & had & (F.col("action") != "flush"), "discarded", F.col("__held")),
    )
    out = steps.withColumn("__held", held)
    return out.withColumn("__e", F.explode(F.array_compact(every))).withColumns({"event": F.col("__e.event"), "item": F.col("__e.item")}).drop("__held", "__e")
