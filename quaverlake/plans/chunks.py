"""Queries of recordings in chunks: a user's events in turn are the samples of a recording."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as C
from .registry import Registry, table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql
CHUNK = 16

_SAMPLES = "e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS total, value / 100 AS v FROM events)"


def recordings(spark, sf, rate: int = 3):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", (F.col("value") / 100).alias("v"))
    return C.cut(e, "user_id", ["ts", "event_id"], "v", rate, CHUNK)


def _places(chunked, name: str):
    """A row a sample."""
    rows = chunked.select("user_id", "chunk_no", F.posexplode("samples").alias("k", "v"))
    return rows.select("user_id", "chunk_no", F.col("k").cast("long").alias("k"), F.round("v", 8).alias(name))


@_R.add("d8_follow", f"""WITH RECURSIVE {_SAMPLES},
f AS (SELECT user_id, n, 0.1::DOUBLE * v AS y FROM e WHERE n = 0 UNION ALL SELECT e.user_id, e.n, y + 0.1::DOUBLE * (v - y) FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, n // {CHUNK} AS chunk_no, n % {CHUNK} AS k, round(y, 8) AS y FROM f""")
def _(spark, sf):
    """The floor that follows a recording."""
    return _places(C.follow(recordings(spark, sf), "user_id"), "y")


@_R.add("d8_onsets", f"""WITH RECURSIVE {_SAMPLES},
f AS (SELECT user_id, -1::BIGINT AS n, 0::DOUBLE AS floor, true AS armed, false AS fire FROM e WHERE n = 0
  UNION ALL SELECT f.user_id, e.n, floor + 0.1::DOUBLE * (v - floor), CASE WHEN armed AND v - floor > 0.12::DOUBLE THEN false ELSE armed OR v <= floor + 0.048::DOUBLE END, armed AND v - floor > 0.12::DOUBLE FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, n AS place FROM f WHERE fire""")
def _(spark, sf):
    return C.onsets(recordings(spark, sf), "user_id")


@_R.add("d8_resample_linear", f"""WITH {_SAMPLES}, t AS (SELECT user_id, total, unnest(range(floor(total * 7 / 3 + 0.5)::BIGINT)) AS i FROM e WHERE n = 0),
p AS (SELECT *, i * 3 / 7 AS at, least(i * 3 // 7, total - 1) AS l FROM t)
SELECT p.user_id, p.i, round(a.v + (coalesce(b.v, a.v) - a.v) * (p.at - p.l), 8) AS v FROM p JOIN e a ON a.user_id = p.user_id AND a.n = p.l LEFT JOIN e b ON b.user_id = p.user_id AND b.n = p.l + 1""")
def _(spark, sf):
    return _numbered(C.resample_linear(recordings(spark, sf), "user_id", 7))


@_R.add("d8_resample_nearest", f"""WITH {_SAMPLES}, t AS (SELECT user_id, unnest(range(total * 2 // 3)) AS i FROM e WHERE n = 0)
SELECT user_id, i, round(v, 8) AS v FROM t JOIN e USING (user_id) WHERE n = i * 3 // 2""")
def _(spark, sf):
    return _numbered(C.resample_nearest(recordings(spark, sf), "user_id", 2))


def _numbered(chunked):
    """A row a sample, numbered over its recording."""
    rows = chunked.select("user_id", "chunk_no", F.posexplode("samples").alias("k", "v"))
    start = C.places(chunked, "user_id").select("user_id", "chunk_no", "start")
    return rows.join(start, ["user_id", "chunk_no"]).select("user_id", (F.col("k") + F.col("start")).alias("i"), F.round("v", 8).alias("v"))
