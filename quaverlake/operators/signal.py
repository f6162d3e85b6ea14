"""Signals as arrays: folds inside Catalyst, and kernels in Arrow batches, one item per row."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONSET, REARM, FOLLOW = 0.12, 0.048, 0.1
SPEECH, SILENCE, SPEECH_MS, SILENCE_MS = 0.5, 0.35, 250, 100
MIN_BPM, MAX_BPM, PREFERRED_BPM, LIKELY_BPM, NEARLY = 60, 200, 125, 120, 0.85
PRIOR_AGREE, PRIOR_OVERRIDE = 0.04, 1.35
BAND_EDGES = (0, 2, 4, 8, 16, 32, 72, 160, 512)


def onsets(values: Column, step_ms: float) -> Column:
    """Times in ms at which an envelope rises over its floor: armed until it fires, and again once it is back."""
    start = F.struct(F.lit(0.0).alias("floor"), F.lit(True).alias("armed"), F.lit(0).alias("i"), F.array().cast("array<double>").alias("out"))

    def step(a, v):
        fire = a["armed"] & (v - a["floor"] > ONSET)
        armed = F.when(fire, False).otherwise(a["armed"] | (v <= a["floor"] + REARM))
        out = F.when(fire, F.concat(a["out"], F.array(a["i"] * step_ms))).otherwise(a["out"])
        return F.struct((a["floor"] + FOLLOW * (v - a["floor"])).alias("floor"), armed.alias("armed"), (a["i"] + 1).alias("i"), out.alias("out"))

    return F.aggregate(values, start, step, lambda a: a["out"])


def speech_spans(points: Column, total: Column) -> Column:
    """points: array of (ms, p). Spans over which p entered at 0.5 and did not stay below 0.35 for 100 ms; over 250 ms only."""
    kind = "array<struct<start_ms:bigint,end_ms:bigint>>"
    none = F.lit(None).cast("bigint")
    start = F.struct(none.alias("open"), none.alias("quiet"), F.array().cast(kind).alias("out"))

    def closed(a, end):
        span = F.struct(a["open"].alias("start_ms"), end.alias("end_ms"))
        return F.when(end - a["open"] > SPEECH_MS, F.concat(a["out"], F.array(span))).otherwise(a["out"])

    def step(a, x):
        quiet = F.coalesce(a["quiet"], x["ms"])
        ends = (x["p"] < SILENCE) & a["open"].isNotNull() & (x["ms"] - quiet >= SILENCE_MS)
        speaks = x["p"] >= SPEECH
        return F.struct(
            F.when(speaks, F.coalesce(a["open"], x["ms"])).when(ends, none).otherwise(a["open"]).alias("open"),
            F.when(speaks | ends, none).when((x["p"] < SILENCE) & a["open"].isNotNull(), quiet).otherwise(a["quiet"]).alias("quiet"),
            F.when(ends, closed(a, quiet)).otherwise(a["out"]).cast(kind).alias("out"),
        )

    return F.aggregate(points, start, step, lambda a: F.when(a["open"].isNotNull() & (total - a["open"] > SPEECH_MS), closed(a, total)).otherwise(a["out"]).cast(kind))


def gain(lufs: Column) -> Column:
    return F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.pow(F.lit(10.0), (F.lit(-14.0) - lufs) / 20)))


def _let(value: Column, then) -> Column:
    """then(value), computed once: a projection would be merged into the lambdas that name it."""
    return F.get(F.transform(F.array(value), then), 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 where either is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def projected_position(status: Column, position: Column, end: Column, staleness: Column) -> Column:
    """Where playback is now: a late sample of something that plays is moved on, not past the end."""
    moved = position + F.greatest(staleness, F.lit(0))
    return F.when((status == "Playing") & (staleness >= 0), F.when(end > 0, F.least(moved, end)).otherwise(moved)).otherwise(position)


def centroid(spectrum: Column) -> Column:
    """Centre of a spectrum as a share of its length; 0 in silence."""
    total = F.aggregate(spectrum, F.lit(0.0), lambda s, v: s + v)
    places = F.transform(spectrum, lambda v, i: v * i)
    return F.when(total > 0, F.aggregate(places, F.lit(0.0), lambda s, v: s + v) / total / F.size(spectrum)).otherwise(F.lit(0.0))


def flux(now: Column, before: Column, start: int = 0, end: int | None = None) -> Column:
    """Mean of the rises, over all bins or those from `start` to before `end`."""
    if start or end is not None:
        now, before = (F.slice(x, start + 1, F.size(x) - start if end is None else F.lit(end - start)) for x in (now, before))
    rises = F.zip_with(now, before, lambda a, b: F.greatest(F.lit(0.0), a - b))
    return F.aggregate(rises, F.lit(0.0), lambda s, v: s + v) / F.size(now)


def bands(spectrum: Column, full: float = 255.0) -> Column:
    """Mean of each of the 8 log bands as a share of `full`; 0 where the spectrum has no bin of a band."""
    parts = [F.slice(spectrum, a + 1, b - a) for a, b in zip(BAND_EDGES, BAND_EDGES[1:])]
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x) / full
    return F.array(*[F.when(F.size(x) > 0, mean(x)).otherwise(F.lit(0.0)) for x in parts])


def _resultants(onset_rows: DataFrame, by: str, at: str, periods: list[float], least: int, prior: str | None, block: int) -> DataFrame:
    """(by, base, n, prior, z): for each period, and last for that of the prior, the sums of cos and sin over a key's n onsets from the first one, base.

    Keys of more than `block` onsets are summed in blocks of about so many different times, dealt by the time's hash, so that
    no task holds a whole key. There is at most one such key per `block` onsets: their list is broadcast.
    """
    bpm = F.col(prior).cast("double") if prior else F.lit(None).cast("double")
    rows = onset_rows.select(F.col(by), F.col(at).cast("double").alias("at"), F.when(bpm.between(MIN_BPM, MAX_BPM), bpm).alias("prior"))
    rows = rows.where(F.abs("at") < float("inf"))
    many = rows.groupBy(F.col(by).alias("__k")).agg(F.min("at").alias("base"), F.count("*").alias("n"), F.max("prior").alias("__prior")).where(F.col("n") > F.lit(block)).where(F.col("n") >= least)
    same = F.col(by).eqNullSafe(F.col("__k"))

    @F.pandas_udf("array<double>")
    def sums(points: pd.Series, weights: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for t, w, p in zip(points, weights, known.astype(float)):
            turns = np.divide.outer(np.asarray(t, float), np.append(periods, 60000 / p))
            turns = (turns - np.floor(turns)) * (2 * math.pi)
            w = np.ones(len(t)) if w is None else np.asarray(w, float)
            out.append(np.concatenate((w @ np.cos(turns), w @ np.sin(turns))))
        return pd.Series(out)

    def fold(points: Column, weights: Column) -> Column:
        n = len(periods) + 1
        both = sums(points, weights, F.col("prior"))
        return F.zip_with(F.slice(both, 1, n), F.slice(both, n + 1, n), lambda re, im: F.struct(re.alias("re"), im.alias("im")))

    key = [by, "base", "n", "prior"]
    n = int(onset_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = rows.join(F.broadcast(many.select("__k")), same, "left_anti").repartition(n, by).groupBy(by)  # few bytes, much to compute: not for one task
    few = few.agg(F.min("at").alias("base"), F.count("*").alias("n"), F.max("prior").alias("prior"), F.array_sort(F.collect_list("at")).alias("t")).where(F.col("n") >= least)
    few = few.withColumn("t", F.transform("t", lambda at: at - F.col("base")))
    hot = rows.drop("prior").join(F.broadcast(many.withColumnRenamed("__prior", "prior")), same).withColumn("b", F.pmod(F.xxhash64("at"), F.ceil(F.col("n") / block)))
    hot = hot.groupBy(*key, "b", "at").agg(F.count("*").cast("double").alias("w")).groupBy(*key, "b").agg(F.array_sort(F.collect_list(F.struct((F.col("at") - F.col("base")).alias("a"), "w"))).alias("t"))
    hot = hot.withColumn("z", fold(F.col("t.a"), F.col("t.w"))).select(*key, F.posexplode("z").alias("i", "z")).groupBy(*key, "i").agg(F.sum("z.re").alias("re"), F.sum("z.im").alias("im"))
    hot = hot.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "re", "im"))), lambda x: F.struct(x["re"].alias("re"), x["im"].alias("im"))).alias("z"))
    return few.select(*key, fold(F.col("t"), F.lit(None).cast("array<double>")).alias("z")).unionByName(hot)


def _sweep(low_ms: float, high_ms: float, step_ms: float) -> list[float]:
    return [k * step_ms + low_ms for k in range(int((high_ms - low_ms) / step_ms) + 1)]


def _strength(z: Column) -> Column:
    return F.sqrt(F.pow(z["re"], 2) + F.pow(z["im"], 2)) / F.col("n")


def tempo_fit(onset_rows: DataFrame, by: str, at: str, low_ms: float = 300.0, high_ms: float = 1000.0, step_ms: float = 2.0, least: int = 8, block: int = 8192) -> DataFrame:
    """(by, period_ms, score): how well the onsets of each key fit a period, for all periods of the sweep."""
    sweep = _sweep(low_ms, high_ms, step_ms)
    found = _resultants(onset_rows, by, at, sweep, least, None, block).select(by, "n", F.posexplode(F.slice("z", 1, len(sweep))).alias("i", "z"))
    return found.select(by, (F.col("i") * step_ms + low_ms).alias("period_ms"), _strength(F.col("z")).alias("score"))


def tempo(onset_rows: DataFrame, by: str, at: str, prior: str | None = None, low_ms: float = 300.0, high_ms: float = 1000.0, step_ms: float = 2.0, least: int = 8, digits: int = 9, block: int = 8192) -> DataFrame:
    """(by, period_ms, score, phase_ms): the period that the onsets of each key fit best, of equal scores (to `digits`) the shortest.

    Half or double of it is taken if it scores over 0.85 of the best and lies nearer the prior, or 125 BPM. A prior (a column
    with the key's BPM; outside 60 to 200 it counts as none) that differs by over 4 % is taken unless beaten 1.35 times.
    """
    sweep = _sweep(low_ms, high_ms, step_ms)
    siblings = [[p * f for f in (0.5, 2.0) if low_ms <= p * f <= high_ms] for p in sweep]
    periods = [*sweep, *sorted({q for two in siblings for q in two} - set(sweep))]
    place = {p: i for i, p in enumerate(periods)}
    found = _resultants(onset_rows, by, at, periods, least, prior, block)

    def scored(z: Column, p: Column) -> Column:
        turn = F.atan2(z["im"], z["re"]) / (2 * math.pi) * p
        return F.struct(p.alias("period_ms"), _strength(z).alias("score"), (F.when(turn < 0, turn + p).otherwise(turn) + F.col("base")).alias("phase_ms"))

    every = F.zip_with(F.slice("z", 1, len(periods)), F.array(*map(F.lit, periods)), scored)
    found = found.select("*", every.alias("s"), F.when(F.col("prior").isNotNull(), scored(F.element_at("z", -1), 60000 / F.col("prior"))).alias("known"))
    top = F.array_max(F.transform(F.slice("s", 1, len(sweep)), lambda x, i: F.struct(F.round(x["score"], digits), -i)))
    others = F.array(*[F.array(*[F.lit(place[q]) for q in two]).cast("array<int>") for two in siblings])
    found = found.withColumn("i", -top["col2"]).withColumn("best", F.col("s")[F.col("i")])
    found = found.withColumn("alike", F.filter(F.transform(others[F.col("i")], lambda i: F.col("s")[i]), lambda x: x["score"] > F.col("best.score") * NEARLY))
    off = lambda x: F.abs(60000 / x["period_ms"] - F.coalesce("prior", F.lit(float(PREFERRED_BPM))))
    found = found.withColumn("best", F.aggregate("alike", F.col("best"), lambda a, x: F.when(off(x) < off(a), x).otherwise(a)))
    known, best = F.col("known"), F.col("best")
    apart = F.abs(best["period_ms"] - known["period_ms"]) / known["period_ms"] > PRIOR_AGREE
    kept = F.when(known["period_ms"].between(low_ms, high_ms) & apart & (best["score"] < known["score"] * PRIOR_OVERRIDE), known).otherwise(best)
    return found.select(by, kept.alias("x")).select(by, "x.*")


def _correlated(df: DataFrame, by: str, chroma: str) -> DataFrame:
    """(by, keys): in each row the correlations of 12 pitch classes with the 24 rotated profiles, which are centred and normed beforehand."""
    from ..functions.kernels import MAJOR, MINOR

    def literal(profile, tonic: int) -> Column:
        p = np.roll(np.asarray(profile, float), tonic)
        p = (p - p.mean()) / np.linalg.norm(p - p.mean())
        return F.array(*map(F.lit, p.tolist()))

    every = F.array(*[F.struct(F.lit(t).alias("tonic"), F.lit(m).alias("major"), literal(p, t).alias("p")) for t in range(12) for m, p in ((True, MAJOR), (False, MINOR))])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    centred = _let(total(F.col(chroma)) / 12, lambda mean: F.transform(F.col(chroma), lambda v: v - mean))

    def against(x: Column) -> Column:
        return _let(F.sqrt(dot(x, x)), lambda norm: F.transform(every, lambda k: F.struct(k["tonic"].alias("tonic"), k["major"].alias("major"), F.when(norm > 0, dot(x, k["p"]) / norm).alias("r"))))

    return df.select(by, _let(centred, against).alias("keys"))


def key_scores(df: DataFrame, by: str, chroma: str) -> DataFrame:
    """(by, tonic, major, r): Pearson correlation of 12 pitch classes with the 24 rotated profiles; null for a flat one."""
    return _correlated(df, by, chroma).select(by, F.explode("keys").alias("k")).select(by, "k.*")


def best_key(df: DataFrame, by: str, chroma: str, least: float = 0.05, digits: int = 9) -> DataFrame:
    """(by, tonic, major, confidence): the best key and its lead over the next one, of at least `least`. Settled inside the row: no shuffle."""
    ranked = F.array_sort(F.transform("keys", lambda k: F.struct((-F.round(k["r"], digits)).alias("o"), k["tonic"].alias("tonic"), (~k["major"]).alias("minor"), k["r"].alias("r"))))
    top = _correlated(df, by, chroma).select(by, F.slice(ranked, 1, 2).alias("k")).select(by, F.col("k")[0].alias("a"), F.col("k")[1].alias("b"))
    lead = F.round(F.col("a.r") - F.col("b.r"), digits)
    return top.where(lead >= least).select(by, "a.tonic", (~F.col("a.minor")).alias("major"), lead.alias("confidence"))


_ANALYSIS = "window_ms double, level array<double>, bass array<double>, treble array<double>, bpm double, beat_confidence double, beats_ms array<double>, tonic int, major boolean, key_confidence double, sections_ms array<double>, lufs double, gain double"


def analyse(df: DataFrame, key: str, samples: str = "samples", rate: str = "rate", made: Callable[..., np.ndarray] | None = None, reads: tuple[str, ...] = ()) -> DataFrame:
    """All measurements of each item (a row with its samples and rate) in one pass; what can't be told is null.

    Samples that can be told from a few numbers needn't be rows: made(*reads) gives them in the task, one item at a time.
    """
    kind, own = df.schema[key].dataType.simpleString(), list(reads) if made else [samples]

    def measured(k, r, x) -> tuple:
        from ..functions import kernels as K

        x = np.asarray(x if x is not None else [], float)
        level = K.envelopes(x, r) if len(x) else np.zeros((3, 0))
        b, chroma = K.beats(x, r), K.chromagram(x, r)[1]
        tone = K.key_of(chroma.mean(0)) if len(chroma) else None
        lufs = K.loudness(x, r)
        return (k, K.WINDOW_MS, *map(list, level), *((b[0], b[1], list(b[2])) if b else (None,) * 3), *(tone or (None,) * 3), K.sections(x, r), lufs, None if lufs is None else min(2.0, max(0.5, 10 ** ((K.TARGET_LUFS - lufs) / 20))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):  # an item's measurements are many numbers
                part = batch.iloc[at : at + 64]
                waves = map(made, *(part[c] for c in own)) if made else part[samples]
                yield pd.DataFrame([measured(*item) for item in zip(part[key], part[rate], waves)], columns=[key, *[f.split(" ")[0] for f in _ANALYSIS.split(", ")]])

    return df.select(key, rate, *own).mapInPandas(run, f"{key} {kind}, {_ANALYSIS}")


def spectra(frames: DataFrame, key: str, at: str = "t", samples: str = "samples") -> DataFrame:
    """frames (key, at, 1024 samples) -> (key, at, levels: 512 of 0 to 255); each frame leans on those before, so a recording is a group."""
    from ..functions.kernels import shown_spectra

    kinds = {n: frames.schema[n].dataType.simpleString() for n in (key, at)}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(at, kind="stable")
        return part[[key, at]].assign(levels=[x.tolist() for x in shown_spectra(np.stack(part[samples].to_list()))])

    return frames.where(F.size(samples) == 1024).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {at} {kinds[at]}, levels array<int>")


def resample_nearest(x: Column, rate: int, to: int) -> Column:
    """Samples at another rate, each the one at or before its time."""
    n = F.floor(F.size(x) * to / rate).cast("int")
    return _per_place(n, lambda i: F.get(x, F.least(F.floor(i * rate / to).cast("int"), F.size(x) - 1)))


def resample_linear(x: Column, rate: int, to: int = 16_000) -> Column:
    """Samples at another rate, each on the line between its two neighbours; the last sample is held."""
    n = F.floor(F.size(x) * to / rate + 0.5).cast("int")

    def at(i: Column) -> Column:
        place = i * rate / to
        left = F.least(F.floor(place).cast("int"), F.size(x) - 1)
        a, b = F.get(x, left).cast("double"), F.get(x, F.least(left + 1, F.size(x) - 1)).cast("double")
        return a + (b - a) * (place - left)

    return _per_place(n, at)


def _per_place(n: Column, value) -> Column:
    """value(i) for i from 0 to before n."""
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), value)


def _measured(df: DataFrame, key: str, reads: list[str], gives: str, measure) -> DataFrame:
    """(key, gives) of each row: measure(*reads) is a tuple, or None for a row of nulls; a null array is empty."""
    kind, names = df.schema[key].dataType.simpleString(), [f.split(" ")[0] for f in gives.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            arrays = (np.asarray(x if x is not None else [], float) for x in batch[reads[0]])
            found = [measure(x, *rest) or (None,) * len(names) for x, *rest in zip(arrays, *(batch[r] for r in reads[1:]))]
            yield pd.DataFrame([(k, *f) for k, f in zip(batch[key], found)], columns=[key, *names])

    return df.select(key, *reads).mapInPandas(run, f"{key} {kind}, {gives}")


def envelopes(df: DataFrame, key: str, samples: str = "samples", rate: str = "rate") -> DataFrame:
    """(key, level, bass, treble): per window of 23 ms, over the largest of all three; an item per row."""
    from ..functions import kernels as K

    return _measured(df, key, [samples, rate], "level array<double>, bass array<double>, treble array<double>", lambda x, r: tuple(map(list, K.envelopes(x, r))))


def periods(df: DataFrame, key: str, envelope: str, fps: float) -> DataFrame:
    """(key, frames, confidence) of the beat of each row's envelope: autocorrelation over the overlap, weighted towards 120 BPM, the
    shortest of equal ones; null for envelopes shorter than twice the longest beat, and for silence. Inside Catalyst."""
    most, least = math.ceil(fps * 60 / MIN_BPM), max(2, int(fps * 60 / MAX_BPM))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    e = F.transform(F.coalesce(F.col(envelope), F.array()), lambda v: v.cast("double"))

    def measured(x: Column) -> Column:
        n, energy = F.size(x), total(F.transform(x, lambda v: v * v))

        def at(k: Column) -> Column:
            r = total(F.zip_with(F.slice(x, 1, n - k), F.slice(x, k + 1, n - k), lambda a, b: a * b)) / (n - k) * n / energy
            weight = F.exp(-0.5 * F.pow(F.log2(60 * fps / k / LIKELY_BPM), 2))
            return _let(r, lambda r: F.struct((r * weight).alias("s"), (-k).alias("k"), r.alias("r")))

        best = F.array_max(F.transform(F.filter(F.sequence(F.lit(least), F.lit(most)), lambda k: k < n), at))
        return F.when((n >= 2 * most) & (energy > 1e-9), best)

    found = df.select(key, _let(e, measured).alias("b"))
    return found.select(key, (-F.col("b.k")).cast("double").alias("frames"), F.when(F.col("b").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("b.r")))).alias("confidence"))


def peaks(df: DataFrame, key: str, curve: str, gap: int, sigma: float = 1.0, floor: float = 0.0) -> DataFrame:
    """(key, places) of the peaks of each row's curve: over mean + sigma deviations and `floor`, no lower than the place before and
    higher than that behind, never at an end; the strongest first, none within `gap` of a stronger one. Inside Catalyst."""
    none = F.array().cast("array<int>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    c = F.transform(F.coalesce(F.col(curve), F.array()), lambda v: v.cast("double"))

    def found(x: Column) -> Column:
        n = F.size(x)

        def over(mean: Column) -> Column:
            return F.greatest(mean + sigma * F.sqrt(total(F.transform(x, lambda v: (v - mean) * (v - mean))) / n), F.lit(float(floor)))

        def chosen(least: Column) -> Column:
            tops = F.filter(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: (i < n - 1) & (F.get(x, i) > least) & (F.get(x, i) >= F.get(x, i - 1)) & (F.get(x, i) > F.get(x, i + 1)))
            strong = F.array_sort(F.transform(tops, lambda i: F.struct((-F.get(x, i)).alias("o"), i.alias("i"))))
            return F.aggregate(strong, none, lambda kept, s: F.when(F.forall(kept, lambda j: F.abs(j - s["i"]) >= gap), F.concat(kept, F.array(s["i"]))).otherwise(kept), lambda kept: F.array_sort(kept))

        return F.when(n >= 3, _let(_let(total(x) / n, over), chosen)).otherwise(none)

    return df.select(key, _let(c, found).alias("places"))


def beat_grids(df: DataFrame, key: str, envelope: str, frames: float) -> DataFrame:
    """(key, beats: frame numbers) of each row's envelope, where a beat takes about `frames`; none in an empty one."""
    from ..functions import kernels as K

    return _measured(df, key, [envelope], "beats array<int>", lambda e: (K.beat_grid(e, frames) if len(e) else [],))


def through_segments(df: DataFrame, key: str, samples: str, work, size: int, overlap: int) -> DataFrame:
    """(key, samples) of each row after work(numpy array of `size`) on overlapping segments."""
    from ..functions import kernels as K

    return _measured(df, key, [samples], f"{samples} array<double>", lambda x: (K.through_segments(x, work, size, overlap),))


def novelties(df: DataFrame, by: str, order: str, vector: str) -> DataFrame:
    """(by, order, novelty) of each frame: how much the frames before it and after it differ. An item's frames are a group, as its length bounds them."""
    from ..functions.kernels import novelty

    kinds = {n: df.schema[n].dataType.simpleString() for n in (by, order)}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        return part[[by, order]].assign(novelty=novelty(np.stack(part[vector].to_list()).astype(float)))

    return df.where(F.size(vector) > 0).select(by, order, vector).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {order} {kinds[order]}, novelty double")
