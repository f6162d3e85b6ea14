"""Queries of the state machines, and of their window forms, over tables: a user's events of one day are a session."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clock import millis
from ..operators import playback
from ..streaming import Easing, Envelope, PhaseLock, Polls, TempoLock, over_table
from .registry import Registry, table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql


def sessions(spark, sf):
    e = table(spark, sf, "events").withColumn("session", F.concat_ws("@", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))
    return e.withColumn("t", millis(F.col("ts")))


def _numbered(columns: str) -> str:
    """Events of a session, numbered by time."""
    return f"e AS (SELECT session, t, row_number() OVER (PARTITION BY session ORDER BY t, event_id) AS n, {columns} FROM (SELECT *, user_id || '@' || strftime(ts, '%Y-%m-%d') AS session, epoch_us(ts) // 1000 AS t FROM events))"


_NEVER = "-1000000000000000::BIGINT"


@_R.add("w1_polls", f"""WITH RECURSIVE {_numbered("CASE WHEN event_id % 4 > 0 THEN 'app' || event_id % 3 END AS app, event_type AS title, event_id % 7 = 0 AS failed")},
f AS (SELECT session, 0::BIGINT AS n, 0::BIGINT AS t, false AS failed, NULL::VARCHAR AS app, NULL::VARCHAR AS title, {_NEVER} AS read_at, false AS fresh FROM e GROUP BY session
  UNION ALL SELECT f.session, e.n, e.t, e.failed, CASE WHEN e.failed THEN f.app ELSE e.app END,
    CASE WHEN NOT e.failed AND e.app IS NOT NULL AND (e.app IS DISTINCT FROM f.app OR e.t - read_at >= 14400000) THEN e.title ELSE f.title END,
    CASE WHEN NOT e.failed AND e.app IS NOT NULL AND (e.app IS DISTINCT FROM f.app OR e.t - read_at >= 14400000) THEN e.t ELSE read_at END,
    NOT e.failed AND e.app IS NOT NULL AND (e.app IS DISTINCT FROM f.app OR e.t - read_at >= 14400000)
  FROM f JOIN e ON e.session = f.session AND e.n = f.n + 1)
SELECT session, t, app, CASE WHEN app IS NOT NULL THEN title END AS title, fresh FROM f WHERE n > 0 AND NOT failed""")
def _(spark, sf):
    """Every seventh poll fails, every fourth finds no player; titles hold for four hours."""
    app = F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("app"), (F.col("event_id") % 3).cast("string")))
    polls = sessions(spark, sf).select("session", "t", app.alias("app"), F.col("event_type").alias("title"), (F.col("event_id") % 7 == 0).alias("failed"))
    return over_table(polls, Polls(14_400_000), "session")


@_R.add("io7_recorder", f"""WITH {_numbered("event_id % 5 * 2000000 AS samples, CASE WHEN event_id % 4 = 0 THEN 16000 ELSE 8000 END AS rate")},
r AS (SELECT *, first_value(rate) OVER (PARTITION BY session ORDER BY n) AS own FROM e),
s AS (SELECT *, own * 720 AS most, coalesce(sum(samples) FILTER (rate = own) OVER (PARTITION BY session ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT session, t, CASE WHEN rate = own THEN greatest(0, least(samples, most - before)) ELSE 0 END::BIGINT AS kept, least(most, before + CASE WHEN rate = own THEN samples ELSE 0 END)::BIGINT AS total,
  before + CASE WHEN rate = own THEN samples ELSE 0 END >= most AS "full" FROM s""")
def _(spark, sf):
    rate = F.when(F.col("event_id") % 4 == 0, 16_000).otherwise(8000)
    batches = sessions(spark, sf).select("session", "t", "event_id", (F.col("event_id") % 5 * 2_000_000).alias("samples"), rate.alias("rate"))
    return playback.recorded(batches, "session", ["t", "event_id"]).select("session", "t", "kept", "total", "full")


@_R.add("w7_envelope", f"""WITH RECURSIVE {_numbered("value % 1 AS b, (value * 7) % 1 AS z, (value * 3) % 1 AS l")},
f AS (SELECT session, 0::BIGINT AS n, 0::BIGINT AS t, 0::DOUBLE AS mean, 0::DOUBLE AS fast, 0::DOUBLE AS slow, 0::DOUBLE AS tf, 0::DOUBLE AS ts, 0::DOUBLE AS kick, 0::DOUBLE AS shown, 0::DOUBLE AS build, false AS "drop", {_NEVER} AS kicked, {_NEVER} AS dropped FROM e GROUP BY session
  UNION ALL SELECT session, n, t, mean, fast, slow, tf, ts, greatest(0.66::DOUBLE * kick, CASE WHEN hit THEN least(1, 4.5::DOUBLE * (b - mean)) ELSE 0 END), grown, CASE WHEN dropping THEN 0 ELSE grown END, dropping, CASE WHEN hit THEN t ELSE kicked END, CASE WHEN dropping THEN t ELSE dropped END
  FROM (SELECT *, b > 0.38::DOUBLE AND b - mean > 0.11::DOUBLE AND (grown > 0.40::DOUBLE OR fast > 1.7::DOUBLE * slow) AND t - dropped > 2000 AS dropping, b > 0.22::DOUBLE AND b - mean > 0.045::DOUBLE AND t - kicked > 130 AS hit
  FROM (SELECT *, CASE WHEN tf > ts + 0.02::DOUBLE AND b < 0.42::DOUBLE AND fast > 0.06::DOUBLE THEN least(1, build + 0.016::DOUBLE) ELSE greatest(0, build - 0.02::DOUBLE) END AS grown
  FROM (SELECT f.session, e.n, e.t, e.b, mean + 0.06::DOUBLE * (b - mean) AS mean, fast + 0.30::DOUBLE * (l - fast) AS fast, slow + 0.02::DOUBLE * (l - slow) AS slow, tf + 0.30::DOUBLE * (z - tf) AS tf, ts + 0.02::DOUBLE * (z - ts) AS ts, kick, build, kicked, dropped
  FROM f JOIN e ON e.session = f.session AND e.n = f.n + 1))))
SELECT session, t, round(kick, 6) AS kick, round(shown, 6) AS build, "drop" FROM f WHERE n > 0""")
def _(spark, sf):
    part = lambda k: F.col("value") * k % 1
    levels = sessions(spark, sf).select("session", "t", (F.col("value") % 1).alias("bass"), part(7).alias("treble"), part(3).alias("level"))
    return over_table(levels, Envelope(), "session").select("session", "t", F.round("kick", 6).alias("kick"), F.round("build", 6).alias("build"), "drop")


@_R.add("w11_tempo_lock", f"""WITH RECURSIVE {_numbered("CASE WHEN event_id % 9 > 0 THEN 120.0::DOUBLE + event_id % 4 END AS bpm, event_id % 20 / 19.0::DOUBLE AS c, event_id % 40 + 10 AS onsets")},
f AS (SELECT session, 0::BIGINT AS n, 0::BIGINT AS t, 0::DOUBLE AS locked, 0::DOUBLE AS last FROM e GROUP BY session
  UNION ALL SELECT f.session, e.n, e.t, CASE WHEN c >= 0.62::DOUBLE AND bpm IS NOT NULL AND last > 0 AND abs(bpm - last) / last <= 0.04::DOUBLE AND onsets >= 24 THEN bpm WHEN bpm IS NULL OR c < 0.40::DOUBLE THEN 0 ELSE locked END,
    CASE WHEN c >= 0.62::DOUBLE AND bpm IS NOT NULL THEN bpm ELSE 0 END FROM f JOIN e ON e.session = f.session AND e.n = f.n + 1)
SELECT session, t, locked > 0 AS locked, CASE WHEN locked > 0 THEN locked END AS bpm FROM f WHERE n > 0""")
def _(spark, sf):
    e = F.col("event_id")
    readings = sessions(spark, sf).select("session", "t", F.when(e % 9 > 0, 120.0 + e % 4).alias("bpm"), (e % 20 / 19.0).alias("confidence"), (e % 40 + 10).alias("onsets"))
    return over_table(readings, TempoLock(), "session")


@_R.add("w11_phase_lock", f"""WITH RECURSIVE {_numbered("CASE WHEN event_id % 9 > 0 THEN 120.0::DOUBLE + event_id % 4 END AS bpm, event_id % 20 / 19.0::DOUBLE AS c, event_id % 40 + 10 AS onsets, CASE WHEN user_id % 3 = 0 THEN 100.0::DOUBLE + user_id % 50 END AS prior, CASE WHEN event_id % 5 > 0 THEN t - event_id % 777 END AS phase, CASE WHEN event_id % 11 = 0 THEN (event_id % 900)::DOUBLE END AS grid")},
f AS (SELECT session, 0::BIGINT AS n, 0::BIGINT AS t, 0::DOUBLE AS locked, 0::DOUBLE AS last, 0::DOUBLE AS clock FROM e GROUP BY session
  UNION ALL SELECT session, n, t, CASE WHEN prior IS NOT NULL THEN prior WHEN locks THEN bpm WHEN bpm IS NULL OR c < 0.40::DOUBLE THEN 0 ELSE locked END,
    CASE WHEN prior IS NOT NULL THEN last WHEN c >= 0.62::DOUBLE AND bpm IS NOT NULL THEN bpm ELSE 0 END,
    CASE WHEN prior IS NOT NULL THEN CASE WHEN grid IS NOT NULL THEN grid % (60000 / prior) WHEN phase IS NOT NULL AND c >= 0.40::DOUBLE THEN (t - phase)::DOUBLE % (60000 / prior) ELSE gone % (60000 / prior) END
      WHEN locks AND phase IS NOT NULL THEN (t - phase)::DOUBLE % (60000 / bpm) ELSE gone END
  FROM (SELECT e.*, f.locked, f.last, CASE WHEN f.locked > 0 THEN (f.clock + e.t - f.t) % (60000 / f.locked) ELSE 0 END AS gone,
    c >= 0.62::DOUBLE AND bpm IS NOT NULL AND f.last > 0 AND abs(bpm - f.last) / f.last <= 0.04::DOUBLE AND onsets >= 24 AS locks FROM f JOIN e ON e.session = f.session AND e.n = f.n + 1))
SELECT session, t, locked > 0 AS locked, CASE WHEN locked > 0 THEN locked END AS bpm, CASE WHEN locked > 0 THEN round(clock, 3) END AS clock FROM f WHERE n > 0""")
def _(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    readings = sessions(spark, sf).select(
        "session", "t", F.when(e % 9 > 0, 120.0 + e % 4).alias("bpm"), (e % 20 / 19.0).alias("confidence"), (e % 40 + 10).alias("onsets"),
        F.when(e % 5 > 0, (F.col("t") - e % 777).cast("double")).alias("phase"), F.when(u % 3 == 0, 100.0 + u % 50).alias("prior"), F.when(e % 11 == 0, (e % 900).cast("double")).alias("grid"),
    )
    return over_table(readings, PhaseLock(), "session").select("session", "t", "locked", "bpm", F.round("clock", 3).alias("clock"))


@_R.add("w12_easing", f"""WITH RECURSIVE {_numbered("value % 1 AS rise, event_id % 10 / 10.0::DOUBLE AS near")},
f AS (SELECT session, 0::BIGINT AS n, 0::BIGINT AS t, 0::DOUBLE AS eased FROM e GROUP BY session
  UNION ALL SELECT f.session, e.n, e.t, eased + (least(1, 1.35::DOUBLE * rise) * near - eased) * CASE WHEN e.n = 1 THEN 1 ELSE least(1, (e.t - f.t) / 30000000.0::DOUBLE) END FROM f JOIN e ON e.session = f.session AND e.n = f.n + 1)
SELECT session, t, round(eased, 6) AS eased FROM f WHERE n > 0""")
def _(spark, sf):
    """A time constant of 30,000 s, as a session's events are hours apart."""
    rises = sessions(spark, sf).select("session", "t", (F.col("value") % 1).alias("rise"), (F.col("event_id") % 10 / 10.0).alias("imminence"))
    return over_table(rises, Easing(30_000_000.0), "session").select("session", "t", F.round("eased", 6).alias("eased"))


@_R.add("w13_record_slot", f"""WITH {_numbered("CASE event_id % 4 WHEN 0 THEN 'flush' WHEN 1 THEN 'stop' ELSE 'start' END AS action, event_type AS item")},
h AS (SELECT *, CASE WHEN lag(action) OVER w = 'start' THEN lag(item) OVER w END AS held FROM e WINDOW w AS (PARTITION BY session ORDER BY n))
SELECT session, t, 'undone' AS event, held AS item FROM h WHERE action = 'start' AND held <> item UNION ALL
SELECT session, t, 'claimed', item FROM h WHERE action = 'start' AND held IS DISTINCT FROM item UNION ALL
SELECT session, t, CASE action WHEN 'flush' THEN 'kept' ELSE 'discarded' END, held FROM h WHERE action <> 'start' AND held IS NOT NULL""")
def _(spark, sf):
    action = F.expr("case event_id % 4 when 0 then 'flush' when 1 then 'stop' else 'start' end")
    steps = sessions(spark, sf).select("session", "t", "event_id", action.alias("action"), F.col("event_type").alias("item"))
    return playback.record_slot(steps, "session", ["t", "event_id"]).select("session", "t", "event", "item")
