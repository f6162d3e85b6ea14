"""Recordings in chunks: (key, chunk_no, sr, samples), a row a chunk; no row, group or task holds a recording.

What a chunk needs from others is a few numbers: where it starts, the next one's first sample, and what a follower
has come to. These are told from one small row a chunk, by windows, and joined back by key and number, so the
chunks of one recording lie in many tasks.

A follower y -> y + share * (x - y) is an affine map of y; those of a chunk's samples make one, y -> a * y + b. The
maps of all chunks before one are composed by doubling: log2(chunks) windows of one order, each over twice as many.

Chunk numbers count from 0 without gaps. Empty chunks are allowed; null samples are empty; a key of no samples
gives no values, and of null is a recording like any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .signal import FOLLOW, ONSET, REARM

CHUNK = 1 << 16
BLOCK = 64


def cut(rows: DataFrame, key: str, order: list[str], value: str, rate: int, chunk: int = CHUNK) -> DataFrame:
    """Chunks of rows that hold one sample each, in the order given."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long") - 1
    rows = rows.select(key, F.col(value).cast("double").alias("v"), n.alias("n")).withColumn("chunk_no", F.expr(f"n div {chunk}"))
    own = rows.groupBy(key, "chunk_no").agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("s"))
    return own.select(key, "chunk_no", F.lit(rate).alias("sr"), F.col("s.v").alias("samples"))


def cut_arrays(df: DataFrame, key: str, samples: str, rate: Column | int, chunk: int = CHUNK) -> DataFrame:
    """Chunks of recordings that come as one array."""
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(samples) / chunk) - 1, F.lit(0)).cast("int"))
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    rows = df.select(key, samples, rate.cast("int").alias("sr"), F.explode(F.when(F.size(samples) > 0, parts)).alias("chunk_no"))
    return rows.select(key, F.col("chunk_no").cast("long").alias("chunk_no"), "sr", F.slice(samples, F.col("chunk_no") * chunk + 1, chunk).alias("samples"))


# --- what chunks tell each other

def _composed(df: DataFrame, by: list[str], order: str, a: str, b: str) -> DataFrame:
    """df plus __a and __b: the map of all rows of a group up to a row, by doubling."""
    w = Window.partitionBy(*by).orderBy(order)
    most = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    now = df.withColumns({"__a": F.col(a), "__b": F.col(b)})
    for k in range(int(most).bit_length()):
        back = 1 << k
        now = now.withColumns({"__p": F.lag("__a", back, 1.0).over(w), "__q": F.lag("__b", back, 0.0).over(w)})
        now = now.withColumns({"__b": F.col("__a") * F.col("__q") + F.col("__b"), "__a": F.col("__a") * F.col("__p")})
    return now.drop("__p", "__q")


def scan(df: DataFrame, key: str, order: str, a: str, b: str, start: float = 0.0) -> DataFrame:
    """df plus `carry`: the maps y -> a * y + b of all rows of the key before a row, in order, applied to `start`."""
    w = Window.partitionBy(key).orderBy(order)
    now = _composed(df, [key], order, a, b)
    now = now.withColumn("carry", F.lag("__a", 1, 1.0).over(w) * start + F.lag("__b", 1, 0.0).over(w))
    return now.drop("__a", "__b")


def scan_rows(df: DataFrame, key: str, block: str, order: str, a: str, b: str, start: float = 0.0) -> DataFrame:
    """df plus `value`: the maps of all rows of the key up to a row, applied to `start`. Blocks rise with the order, which is
    unique in them; a task holds a block, or a key's blocks by one small row each."""
    inner = _composed(df, [key, block], order, a, b)
    ends = inner.groupBy(key, block).agg(F.max_by(F.struct("__a", "__b"), order).alias("e")).select(key, block, F.col("e.__a").alias("a"), F.col("e.__b").alias("b"))
    carries = scan(ends, key, block, "a", "b", start).select(F.col(key).alias("__key"), F.col(block).alias("__block"), "carry")
    rows = inner.join(carries, F.col(key).eqNullSafe(F.col("__key")) & (F.col(block) == F.col("__block")))
    return rows.withColumn("value", F.col("__a") * F.col("carry") + F.col("__b")).drop("__a", "__b", "__key", "__block", "carry")


def eased(rows: DataFrame, key: str, constant_ms: float = 260.0, block_ms: int = 600_000) -> DataFrame:
    """rows (key, t in ms, rise, imminence) -> (key, t, eased): rise times imminence, followed with a time constant; rows of one
    time are taken by rise and imminence. As the machine `Easing`, with a key's rows in blocks of `block_ms`."""
    rows = rows.select(key, "t", "rise", "imminence", F.floor(F.col("t") / block_ms).alias("block"))
    w = Window.partitionBy(key, "block").orderBy("t", "rise", "imminence")
    rows = rows.withColumns({"n": F.row_number().over(w), "before": F.lag("t").over(w)})
    last = rows.groupBy(key, "block").agg(F.max("t").alias("last"))
    last = last.select(F.col(key).alias("__key"), F.col("block").alias("__block"), F.lag("last").over(Window.partitionBy(key).orderBy("block")).alias("last"))
    rows = rows.join(last, F.col(key).eqNullSafe(F.col("__key")) & (F.col("block") == F.col("__block"))).drop("__key", "__block")
    gap = (F.col("t") - F.coalesce("before", "last")) / constant_ms
    share = F.when(gap.isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), gap)))
    want = F.least(F.lit(1.0), 1.35 * F.col("rise")) * F.col("imminence")
    rows = rows.withColumns({"a": 1 - share, "b": share * want})
    return scan_rows(rows, key, "block", "n", "a", "b").select(key, "t", F.col("value").alias("eased"))


def places(chunks: DataFrame, key: str) -> DataFrame:
    """(key, chunk_no, start, following, total): of each chunk the number of its first sample, and the sample after its last."""
    n = F.coalesce(F.size("samples"), F.lit(0)).cast("long")
    told = chunks.select(key, "chunk_no", F.greatest(n, F.lit(0)).alias("n"), F.get("samples", F.lit(0)).cast("double").alias("first"))
    w = Window.partitionBy(key).orderBy("chunk_no")
    return told.select(
        key, "chunk_no",
        F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.first("first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("following"),
        F.sum("n").over(Window.partitionBy(key)).alias("total"),
    )


def _with(chunks: DataFrame, told: DataFrame, key: str) -> DataFrame:
    told = told.withColumnsRenamed({key: "__key", "chunk_no": "__no"})
    return chunks.join(told, F.col(key).eqNullSafe(F.col("__key")) & (F.col("chunk_no") == F.col("__no"))).drop("__key", "__no")


# --- followers

def followed(x: np.ndarray, share: float, start: float) -> np.ndarray:
    """The follower after each sample."""
    keep = 1.0 - share
    lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    within = np.where(lag >= 0, share * keep ** np.maximum(lag, 0), 0.0)
    fade = keep ** np.arange(1, BLOCK + 1)
    out = np.zeros(-(-len(x) // BLOCK) * BLOCK)
    out[: len(x)] = x
    out = out.reshape(-1, BLOCK) @ within.T
    for row in out:
        row += fade * start
        start = row[-1]
    return out.ravel()[: len(x)]


def _arrays(batch: pd.DataFrame) -> list[np.ndarray]:
    return [np.asarray(x if x is not None else [], float) for x in batch["samples"]]


def _kind(df: DataFrame, key: str) -> str:
    return f"{key} {df.schema[key].dataType.simpleString()}, chunk_no long"


def _carries(chunks: DataFrame, key: str, share: float, start: float) -> DataFrame:
    """(key, chunk_no, carry): the follower before each chunk."""

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            xs = _arrays(batch)
            b = [followed(x, share, 0.0)[-1] if len(x) else 0.0 for x in xs]
            yield batch[[key, "chunk_no"]].assign(a=[(1.0 - share) ** len(x) for x in xs], b=b)

    told = chunks.select(key, "chunk_no", "samples").mapInPandas(ends, f"{_kind(chunks, key)}, a double, b double")
    return scan(told, key, "chunk_no", "a", "b", start).select(key, "chunk_no", "carry")


def follow(chunks: DataFrame, key: str, share: float = FOLLOW, start: float = 0.0) -> DataFrame:
    """The chunks with the follower after each sample in place of the samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            y = [followed(x, share, c) for x, c in zip(_arrays(batch), batch["carry"])]
            yield batch[[key, "chunk_no", "sr"]].assign(samples=y)

    rows = _with(chunks.select(key, "chunk_no", "sr", "samples"), _carries(chunks, key, share, start), key)
    return rows.mapInPandas(run, f"{_kind(chunks, key)}, sr int, samples array<double>")


def onsets(chunks: DataFrame, key: str) -> DataFrame:
    """(key, place): numbers of the samples that rise over the floor that follows them, once each time they came back to it.

    A sample over the floor by ONSET disarms and one by no more than REARM arms, whatever was before; so what a chunk
    hands on is its last such sample, and only its first rise depends on the chunks before.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x, c in zip(_arrays(batch), batch["carry"]):
                over = x - np.concatenate(([c], followed(x, FOLLOW, c)[:-1])) if len(x) else x
                told = np.flatnonzero((over > ONSET) | (over <= REARM))
                rise = over[told] > ONSET
                fires = told[1:][rise[1:] & ~rise[:-1]]
                out.append((fires, told[0] if len(told) and rise[0] else None, not rise[-1] if len(told) else None))
            found = pd.DataFrame(out, columns=["fires", "first", "armed"], index=batch.index).astype({"first": "Int64", "armed": "boolean"})
            yield pd.concat([batch[[key, "chunk_no"]], found], axis=1)

    rows = _with(chunks.select(key, "chunk_no", "samples"), _carries(chunks, key, FOLLOW, 0.0), key)
    found = rows.mapInPandas(run, f"{_kind(chunks, key)}, fires array<long>, first long, armed boolean")
    before = Window.partitionBy(key).orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    armed = F.coalesce(F.last("armed", ignorenulls=True).over(before), F.lit(True))
    found = found.withColumn("fires", F.when(F.col("first").isNotNull() & armed, F.concat(F.array("first"), F.col("fires"))).otherwise(F.col("fires")))
    found = _with(found.where(F.size("fires") > 0).select(key, "chunk_no", "fires"), places(chunks, key), key)
    return found.select(key, F.explode("fires").alias("at"), "start").select(key, (F.col("at") + F.col("start")).alias("place"))


# --- other rates

def _resampled(chunks: DataFrame, key: str, to: int, count: Column, value: Callable[[Column, Column], Column]) -> DataFrame:
    """Chunks at the rate `to`; the i-th sample is made by the chunk that holds the one at or before its time."""
    rows = _with(chunks.select(key, "chunk_no", "sr", "samples"), places(chunks, key), key).where(F.size("samples") > 0)
    rate, n = F.col("sr").cast("long"), F.size("samples").cast("long")
    first_at = lambda place: F.call_function("div", place * to + rate - 1, rate)  # noqa: E731  the first i at or after it
    last = F.col("start") + n >= F.col("total")
    low = first_at(F.col("start"))
    high = F.when(last, count).otherwise(F.least(first_at(F.col("start") + n), count))
    rows = rows.withColumns({"low": low, "high": high})
    made = F.transform(F.when(F.col("high") > F.col("low"), F.sequence("low", F.col("high") - 1)).otherwise(F.array().cast("array<long>")), lambda i: value(i, rate))
    rows = rows.withColumn("made", made)  # first, as a lambda's `sr` could mean the new one
    return rows.select(key, "chunk_no", F.lit(to).alias("sr"), F.col("made").alias("samples"))


def resample_linear(chunks: DataFrame, key: str, to: int = 16_000) -> DataFrame:
    """Chunks at another rate, each sample on the line between its two neighbours; the last sample is held."""
    count = F.floor(F.col("total") * to / F.col("sr") + 0.5)

    def value(i: Column, rate: Column) -> Column:
        place = i * rate / to
        k = F.least(F.floor(place) - F.col("start"), F.size("samples").cast("long") - 1).cast("int")
        a = F.get("samples", k).cast("double")
        b = F.coalesce(F.get("samples", k + 1).cast("double"), F.col("following"), a)
        return a + (b - a) * (place - F.col("start") - k)

    return _resampled(chunks, key, to, count, value)


def resample_nearest(chunks: DataFrame, key: str, to: int) -> DataFrame:
    """Chunks at another rate, each sample the one at or before its time."""
    count = F.floor(F.col("total") * to / F.col("sr"))
    return _resampled(chunks, key, to, count, lambda i, rate: F.get("samples", F.least(F.call_function("div", i * rate, F.lit(to).cast("long")) - F.col("start"), F.size("samples").cast("long") - 1).cast("int")).cast("double"))


# --- windows

WINDOW_MS, LOW_HZ, HIGH_HZ = 23.0, 200.0, 4000.0


def envelopes(chunks: DataFrame, key: str, rate: int) -> DataFrame:
    """(key, place, level, bass, treble): root mean squares of whole windows of 23 ms of a recording, of what lies under the low pole
    and over the high one, each over the largest of all. Windows may reach over chunks; a task holds a chunk."""
    n = max(1, round(rate * WINDOW_MS / 1000))
    share = lambda hz: 1 - math.exp(-2 * math.pi * hz / rate)
    parts = chunks.select(key, "chunk_no", "samples").where(F.size("samples") > 0)
    for name, hz in (("low", LOW_HZ), ("high", HIGH_HZ)):
        parts = _with(parts, follow(chunks, key, share(hz)).select(key, "chunk_no", F.col("samples").alias(name)), key)
    parts = _with(parts, places(chunks, key).select(key, "chunk_no", "start"), key)
    rows = parts.select(key, "start", F.posexplode(F.arrays_zip("samples", "low", "high")).alias("__k", "__x"))
    square = lambda c: F.sqrt(F.avg(c * c))
    sample = F.col("__x.samples").cast("double")
    place = F.floor((F.col("start") + F.col("__k")) / n).alias("place")
    found = rows.groupBy(key, place).agg(F.count("*").alias("__n"), square(sample).alias("level"), square(F.col("__x.low")).alias("bass"), square(sample - F.col("__x.high")).alias("treble"))
    found = found.where(F.col("__n") == n)
    top = F.max(F.greatest("level", "bass", "treble")).over(Window.partitionBy(key))
    scaled = lambda c: F.when(F.col("top") > 0, F.col(c) / F.col("top")).otherwise(F.col(c)).alias(c)
    return found.withColumn("top", top).select(key, "place", *map(scaled, ("level", "bass", "treble")))
