"""Queries of signal operators: events of a user as an envelope or as onsets, embeddings as spectra and chroma."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.clock import millis
from ..operators import chunks as C
from ..operators import signal as S
from ..streaming import Speech, over_table
from .registry import Registry, table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql


def envelope(spark, sf):
    return table(spark, sf, "events").select("user_id", F.col("ts").alias("t"), F.col("event_id").alias("id"), (F.col("value") / 100).alias("v"), (F.col("value") / 200).alias("p"))


@_R.add("s2_onsets", """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value / 100 AS v FROM events),
f AS (SELECT user_id, 0::BIGINT AS n, 0::DOUBLE AS floor, true AS armed, false AS fire FROM e GROUP BY user_id
  UNION ALL SELECT f.user_id, e.n, floor + 0.1::DOUBLE * (v - floor), CASE WHEN armed AND v - floor > 0.12::DOUBLE THEN false ELSE armed OR v <= floor + 0.048::DOUBLE END, armed AND v - floor > 0.12::DOUBLE FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, count(*) FILTER (fire)::BIGINT AS onsets, coalesce(string_agg(((n - 1) * 23)::BIGINT, ',' ORDER BY n) FILTER (fire), '') AS at FROM f GROUP BY user_id""")
def _(spark, sf):
    samples = envelope(spark, sf)
    found = C.onsets(C.cut(samples, "user_id", ["t", "id"], "v", 1, 256), "user_id").select("user_id", (F.col("place") * 23).alias("t"))
    t = samples.select("user_id").distinct().join(found.groupBy("user_id").agg(F.array_sort(F.collect_list("t")).alias("t")), "user_id", "left")
    return t.select("user_id", F.coalesce(F.size("t"), F.lit(0)).cast("long").alias("onsets"), F.coalesce(F.array_join(F.transform("t", lambda x: x.cast("string")), ","), F.lit("")).alias("at"))


@_R.add("m1_speech_spans", """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value / 200 AS p, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 64 AS ms FROM events),
f AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS open, NULL::BIGINT AS quiet, NULL::BIGINT AS a, NULL::BIGINT AS z FROM e GROUP BY user_id
  UNION ALL SELECT user_id, n, CASE WHEN p >= 0.5 THEN coalesce(open, ms) WHEN NOT ends THEN open END, CASE WHEN p >= 0.5 OR ends THEN NULL WHEN p < 0.35 AND open IS NOT NULL THEN since ELSE quiet END, CASE WHEN ends THEN open END, CASE WHEN ends THEN since END
  FROM (SELECT *, p < 0.35 AND open IS NOT NULL AND ms - since >= 100 AS ends FROM (SELECT e.*, open, quiet, coalesce(quiet, ms) AS since FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))),
u AS (SELECT user_id, a, z FROM f UNION ALL (SELECT user_id, open, n * 64 FROM f QUALIFY n = max(n) OVER (PARTITION BY user_id)))
SELECT user_id, a AS start_ms, z AS end_ms FROM u WHERE z - a > 250""")
def _(spark, sf):
    return over_table(envelope(spark, sf), Speech(64), "user_id")


@_R.add("s7_tempo_from_gaps", """WITH g AS (SELECT user_id, (epoch_us(ts) // 1000) % 100000 AS t FROM events), d AS (SELECT user_id, lead(t) OVER (PARTITION BY user_id ORDER BY t) - t AS gap FROM g)
SELECT user_id, round(median(gap), 6) AS gap, CASE WHEN median(gap) > 0 AND 60000 / median(gap) BETWEEN 60 AND 200 THEN round(60000 / median(gap), 6) END AS bpm FROM d WHERE gap IS NOT NULL GROUP BY user_id""")
def _(spark, sf):
    t = table(spark, sf, "events").select("user_id", (millis(F.col("ts")) % 100000).alias("t"))
    gaps = t.select("user_id", (F.lead("t").over(Window.partitionBy("user_id").orderBy("t")) - F.col("t")).alias("gap")).where("gap is not null")
    m = gaps.groupBy("user_id").agg(F.median("gap").alias("gap"))
    bpm = F.when(F.col("gap") > 0, 60000 / F.col("gap"))
    return m.select("user_id", F.round("gap", 6).alias("gap"), F.when(bpm.between(K.MIN_BPM, K.MAX_BPM), F.round(bpm, 6)).alias("bpm"))


_PROFILES = ", ".join(f"({t}, {m}, [{', '.join(str(p[(i - t) % 12]) for i in range(12))}]::DOUBLE[])" for t in range(12) for m, p in (("true", K.MAJOR), ("false", K.MINOR)))


@_R.add("s9_key", f"""WITH k(tonic, major, p) AS (VALUES {_PROFILES}), c AS (SELECT vec_id, unnest(embedding[1:12]) AS v, unnest(range(1, 13)) AS i FROM embeddings),
r AS (SELECT vec_id, tonic, major, corr(abs(v)::DOUBLE, p[i]) AS r FROM c, k GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(r, 9) DESC, tonic, major DESC) AS n FROM r)
SELECT a.vec_id, a.tonic, a.major, round(a.r - b.r, 6) AS confidence FROM o a JOIN o b ON a.vec_id = b.vec_id AND a.n = 1 AND b.n = 2 WHERE round(a.r - b.r, 9) >= 0.05""")
def _(spark, sf):
    c = table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 12), lambda v: F.abs(v).cast("double")).alias("c"))
    return S.best_key(c, "vec_id", "c").withColumn("confidence", F.round("confidence", 6))


@_R.add("s14_gain", "SELECT event_id, round(least(2.0, greatest(0.5, pow(10.0, (-14.0 + value / 10) / 20))), 6)::DOUBLE AS gain FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(S.gain(-F.col("value") / 10), 6).alias("gain"))


@_R.add("w3_projected_position", """WITH e AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 'Paused' ELSE 'Playing' END AS s, user_id * 1000 AS p, (event_id % 5) * 30000 AS z, event_id % 4 * 5000 - 1 AS l FROM events)
SELECT event_id, CASE WHEN s = 'Playing' AND l >= 0 THEN CASE WHEN z > 0 THEN least(p + l, z) ELSE p + l END ELSE p END::BIGINT AS position FROM e""")
def _(spark, sf):
    status = F.when(F.col("event_type") == "view", "Paused").otherwise("Playing")
    at = S.projected_position(status, F.col("user_id") * 1000, F.col("event_id") % 5 * 30000, F.col("event_id") % 4 * 5000 - 1)
    return table(spark, sf, "events").select("event_id", at.alias("position"))


@_R.add("w6_spectrum", """WITH s AS (SELECT vec_id, list_transform(embedding, lambda v: abs(v)::DOUBLE) AS s FROM embeddings), b AS (SELECT *, lag(s) OVER (ORDER BY vec_id) AS p FROM s)
SELECT vec_id, round(list_sum(list_transform(s, lambda v, i: v * (i - 1))) / list_sum(s) / len(s), 6) AS centroid, round(list_sum(list_transform(list_zip(s, p), lambda x: greatest(0, x[1] - x[2]))) / len(s), 6) AS flux FROM b WHERE vec_id % 16 <> 0""")
def _(spark, sf):
    """Frames of streams: 16 vectors in turn make a stream."""
    s = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v).cast("double")).alias("s"))
    b = s.withColumn("p", F.lag("s").over(Window.partitionBy(F.floor(F.col("vec_id") / 16)).orderBy("vec_id"))).where("p is not null")
    return b.select("vec_id", F.round(S.centroid(F.col("s")), 6).alias("centroid"), F.round(S.flux(F.col("s"), F.col("p")), 6).alias("flux"))


@_R.add("w9_tempo", """WITH o AS (SELECT user_id, (epoch_us(ts) // 1000) - min((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id) AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events),
p AS (SELECT unnest(range(300, 1001))::DOUBLE AS period_ms),
s AS (SELECT user_id, period_ms, sqrt(pow(sum(cos(t / period_ms * 2 * pi())), 2) + pow(sum(sin(t / period_ms * 2 * pi())), 2)) / count(*) AS score FROM o, p WHERE n >= 8 GROUP BY ALL),
b AS (SELECT user_id, period_ms AS best, score AS top FROM s WHERE period_ms::BIGINT % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 5) DESC, period_ms) = 1)
SELECT user_id, period_ms, round(score, 5) AS score FROM b JOIN s USING (user_id)
WHERE period_ms = best OR (period_ms IN (best / 2, best * 2) AND score > 0.85::DOUBLE * top)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(60000 / period_ms - 125), period_ms <> best, period_ms) = 1""")
def _(spark, sf):
    fit = S.tempo(table(spark, sf, "events").select("user_id", millis(F.col("ts")).alias("t")), "user_id", "t", digits=5)
    return fit.select("user_id", "period_ms", F.round("score", 5).alias("score"))


@_R.add("w8_rolling_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) RANGE BETWEEN 12000000 PRECEDING AND CURRENT ROW)::BIGINT AS onsets FROM events")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy(millis(F.col("ts"))).rangeBetween(-12_000_000, 0)
    return table(spark, sf, "events").select("event_id", F.count("*").over(w).alias("onsets"))


@_R.add("m13_cosine", """WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS a, lag(embedding) OVER (PARTITION BY vec_id // 40 ORDER BY vec_id)::DOUBLE[] AS b FROM embeddings)
SELECT vec_id, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a)) / sqrt(list_dot_product(b, b)), 6) AS cosine FROM p WHERE b IS NOT NULL""")
def _(spark, sf):
    w = Window.partitionBy(F.floor(F.col("vec_id") / 40)).orderBy("vec_id")
    p = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"), F.lag("embedding").over(w).alias("b")).where("b is not null")
    return p.select("vec_id", F.round(S.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


_SCALE = {0: 1.0, 2: 0.3, 4: 0.6, 5: 0.4, 7: 0.8, 9: 0.4, 11: 0.3}


@lru_cache(12)
def _scale(root: float) -> np.ndarray:
    """12 s at 8 kHz of two octaves of a major scale."""
    x = np.arange(96000) / 8000.0
    return sum(w / 12 * np.sin(root * 2 ** (octave + step / 12) * x) for octave in (0, 1) for step, w in _SCALE.items())


@lru_cache(60)
def _clicks(beat: float) -> np.ndarray:
    x = np.arange(96000) / 8000.0
    return np.exp(-60 * (x % beat)) * np.sin(22000 * x)


@_R.add("s21_analysis")
def _(spark, sf):
    """All measurements of a recording per user: 12 s at 8 kHz, a major scale on the user's tone under clicks at the user's tempo, as loud as the user's events."""
    users = table(spark, sf, "events").groupBy("user_id").agg((F.avg(F.abs("value")) / 100).alias("loud"))
    users = users.withColumns({"root": 2 * math.pi * 130.81 * F.pow(F.lit(2.0), F.col("user_id") % 12 / 12), "beat": 60.0 / (90 + F.col("user_id") % 60), "rate": F.lit(8000)})

    def wave(loud: float, root: float, beat: float) -> np.ndarray:
        return loud * (_scale(root) + _clicks(beat))

    # few bytes, much to compute: not for one task. By the user it would be the aggregate's own shuffle, whose parts are put together
    users = users.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = S.analyse(users, "user_id", made=wave, reads=("loud", "root", "beat"))
    return found.select("user_id", F.size("level").alias("windows"), F.round("bpm", 3).alias("bpm"), "tonic", "major", F.round("lufs", 3).alias("lufs"))
