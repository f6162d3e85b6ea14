"""Queries of histories, energy maps and counters over the event table: users listen, event types are items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.clock import millis
from ..operators import energy, history
from .registry import Registry, table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql
_ORDER = ["ts", "event_id"]

_HISTORY = f"""h AS (SELECT user_id, event_type, ts, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
  WHERE event_type IS DISTINCT FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= {history.HISTORY})"""


def plays(spark, sf):
    return history.collapse_repeats(table(spark, sf, "events"), "user_id", "event_type", _ORDER)


_NEXT = """p AS (SELECT user_id, event_type, lead(event_type) OVER w AS next_key, row_number() OVER w AS pos FROM h WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT user_id, event_type, next_key, count(*) AS n, max(pos) AS last FROM p WHERE next_key IS NOT NULL GROUP BY user_id, event_type, next_key HAVING count(*) >= 2),
nx AS (SELECT user_id, event_type, next_key, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY n DESC, last DESC) = 1)"""


@_R.add("a1_next_item", f"WITH {_HISTORY}, {_NEXT} SELECT user_id, event_type, next_key, n::BIGINT AS n FROM nx")
def _(spark, sf):
    return history.next_item(plays(spark, sf), "user_id", "event_type", _ORDER)


@_R.add("a2_history", f"WITH {_HISTORY} SELECT user_id, event_id, event_type FROM h")
def _(spark, sf):
    return plays(spark, sf).select("user_id", "event_id", "event_type")


@_R.add("x5_speculative", f"""WITH {_HISTORY}, {_NEXT}, l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM h GROUP BY user_id)
SELECT user_id, next_key, event_type FROM l JOIN nx USING (user_id, event_type) WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = nx.user_id AND e.event_type = nx.next_key AND e.value > 480)""")
def _(spark, sf):
    own = plays(spark, sf)
    cache = table(spark, sf, "events").where("value > 480").select("user_id", "event_type").distinct()
    return history.speculative(own, history.next_item(own, "user_id", "event_type", _ORDER), cache, "user_id", "event_type", _ORDER).select("user_id", "next_key", "event_type")


@_R.add("w2_changes", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type IS DISTINCT FROM b")
def _(spark, sf):
    return history.changes(table(spark, sf, "events"), "user_id", "event_type", _ORDER).select("user_id", "event_id", "event_type")


@_R.add("io23_counters", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS page, count(*)::BIGINT AS n FROM events GROUP BY GROUPING SETS ((), (day), (page))")
def _(spark, sf):
    return history.counters(table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("page")), "day", "page")


@_R.add("io24_readback", "WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT day, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS pages FROM c GROUP BY day")
def _(spark, sf):
    counts = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").count()
    pairs = counts.groupBy("day").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "count")))).alias("m"))
    return pairs.select("day", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("pages"))


@_R.add("a27_tally", "SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY event_type")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


# --- energy maps

_SAMPLES = """s AS (SELECT user_id, (epoch_us(ts) // 1000) - min((epoch_us(ts) // 1000)) OVER w AS pos, max((epoch_us(ts) // 1000)) OVER w - min((epoch_us(ts) // 1000)) OVER w AS dur,
  value / 500 AS level, value / 1000 AS bass, value / 700 AS treble FROM events WINDOW w AS (PARTITION BY user_id)),
m AS (SELECT user_id, least(95, floor(pos / dur * 96))::INTEGER AS bin, max(level) AS level, max(bass) AS bass, max(treble) AS treble, count(*) AS n FROM s WHERE dur > 0 GROUP BY ALL)"""
_CELLS = f"{_SAMPLES}, c AS (SELECT user_id, bin, n >= 2 AS known, least(1, level / max(level) OVER (PARTITION BY user_id)) AS level, least(1, bass / max(level) OVER (PARTITION BY user_id)) AS bass FROM m)"


def samples(spark, sf):
    w = Window.partitionBy("user_id")
    t = table(spark, sf, "events").withColumn("t", millis(F.col("ts")))
    return t.select("user_id", (F.col("t") - F.min("t").over(w)).alias("pos_ms"), (F.max("t").over(w) - F.min("t").over(w)).alias("duration_ms"),
                    (F.col("value") / 500).alias("level"), (F.col("value") / 1000).alias("bass"), (F.col("value") / 700).alias("treble"))


def maps(spark, sf):
    return energy.heat_map(samples(spark, sf), "user_id")


@_R.add("a9_heat_map", f"WITH {_SAMPLES} SELECT user_id, bin, round(level, 6) AS level, round(bass, 6) AS bass, round(treble, 6) AS treble, n::BIGINT AS n FROM m")
def _(spark, sf):
    return maps(spark, sf).select("user_id", "bin", *[F.round(c, 6).alias(c) for c in ("level", "bass", "treble")], "n")


@_R.add("a10_merge_maps", f"""WITH {_SAMPLES}, d AS (SELECT user_id, max(dur) AS d FROM s GROUP BY user_id),
o AS (SELECT user_id, bin, d + CASE WHEN user_id % 2 = 0 THEN 500 ELSE 60000 END AS dur, level * 1.5 AS level, n FROM m JOIN d USING (user_id) WHERE bin % 2 = 0),
b AS (SELECT user_id, bin, d AS dur, level, n FROM m JOIN d USING (user_id) UNION ALL SELECT o.* FROM o JOIN d USING (user_id) WHERE abs(dur - d) <= 2000)
SELECT user_id, bin, max(dur)::BIGINT AS duration_ms, round(max(level), 6) AS level, sum(n)::BIGINT AS n FROM b GROUP BY ALL""")
def _(spark, sf):
    length = samples(spark, sf).groupBy("user_id").agg(F.max("duration_ms").alias("duration_ms"))
    new = maps(spark, sf).join(length, "user_id")
    shift = F.when(F.col("user_id") % 2 == 0, 500).otherwise(60000)
    old = new.where("bin % 2 = 0").withColumns({"duration_ms": F.col("duration_ms") + shift, "level": F.col("level") * 1.5})
    return energy.merge_maps(old, new, "user_id").select("user_id", "bin", "duration_ms", F.round("level", 6).alias("level"), "n")


@_R.add("a11_cells", f"WITH {_CELLS} SELECT user_id, bin, known, round(level, 9) AS level, round(bass, 9) AS bass FROM c")
def _(spark, sf):
    return energy.cells(maps(spark, sf), "user_id").select("user_id", "bin", "known", F.round("level", 9).alias("level"), F.round("bass", 9).alias("bass"))


@_R.add("a12_coverage", f"WITH {_SAMPLES} SELECT user_id, round(count(*) FILTER (n >= 2) / 96.0, 6)::DOUBLE AS coverage FROM m GROUP BY user_id")
def _(spark, sf):
    return energy.coverage(maps(spark, sf), "user_id").select("user_id", F.round("coverage", 6).alias("coverage"))


@_R.add("a13_lookahead", f"""WITH {_CELLS}, p AS (SELECT a.user_id, a.bin, a.level, max(b.level) AS peak, arg_max(b.bin, (b.level, -b.bin)) AS top
  FROM c a LEFT JOIN c b ON a.user_id = b.user_id AND b.bin > a.bin AND b.bin <= a.bin + 8 AND b.known AND b.level > 0 WHERE a.known GROUP BY ALL)
SELECT user_id, bin, round(level, 6) AS level, round(coalesce(peak, 0), 6) AS peak, round(coalesce(greatest(0, least(1, peak - level)), 0), 6)::DOUBLE AS rise, round(coalesce(1 - (top - bin) / 8, 0), 6)::DOUBLE AS imminence FROM p""")
def _(spark, sf):
    out = energy.lookahead(energy.cells(maps(spark, sf), "user_id"), "user_id", 8)
    return out.select("user_id", "bin", *[F.round(c, 6).alias(c) for c in ("level", "peak", "rise", "imminence")])


@_R.add("a14_tier_sections")
def _(spark, sf):
    """Users of the same remainder play the same item: only maps of many plays are known well enough."""
    plays = samples(spark, sf).withColumn("item", F.col("user_id") % 30)
    return energy.tier_sections(energy.cells(energy.heat_map(plays, "item"), "item"), "item")


@_R.add("a15_measured_sections", f"""WITH {_CELLS}, u AS (SELECT DISTINCT user_id FROM c), g AS (SELECT user_id, unnest(range(96))::INTEGER AS bin FROM u),
f AS (SELECT g.user_id, g.bin, coalesce(avg(c.level), 0) AS smooth FROM g LEFT JOIN c ON c.user_id = g.user_id AND c.known AND abs(c.bin - g.bin) <= 1 GROUP BY ALL),
r AS (SELECT user_id, unnest([0, 24 + user_id % 8, 60])::INTEGER AS a, unnest([23 + user_id % 8, 59, 95])::INTEGER AS z FROM u),
l AS (SELECT r.user_id, a, z, avg(smooth) AS level FROM r JOIN f ON f.user_id = r.user_id AND bin BETWEEN a AND z GROUP BY ALL),
t AS (SELECT *, CASE WHEN round(level, 9) >= 0.72 THEN 2 WHEN round(level, 9) >= 0.4 THEN 1 ELSE 0 END AS tier FROM l),
k AS (SELECT *, lead(tier) OVER w AS nt, row_number() OVER w AS rn FROM t WINDOW w AS (PARTITION BY user_id ORDER BY a))
SELECT user_id, a AS first_bin, z AS last_bin, round(level, 6) AS level,
  CASE WHEN tier = 2 THEN 'drop' WHEN tier = 1 THEN CASE WHEN nt = 2 THEN 'build' ELSE 'verse' END WHEN rn = 1 THEN 'intro' WHEN nt IS NULL THEN 'outro' ELSE 'break' END AS kind FROM k""")
def _(spark, sf):
    scaled = energy.cells(maps(spark, sf), "user_id")
    starts = scaled.select("user_id").distinct().select("user_id", F.explode(F.array(F.lit(0), (24 + F.col("user_id") % 8).cast("int"), F.lit(60))).alias("first_bin"))
    return energy.measured_sections(scaled, starts, "user_id").select("user_id", "first_bin", "last_bin", F.round("level", 6).alias("level"), "kind")


@_R.add("a20_beat_map", """WITH RECURSIVE e AS (SELECT user_id, (epoch_us(ts) // 1000) - min((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id) AS t, value / 500 AS level, value / 1000 * 2 AS kick FROM events),
c AS (SELECT user_id, 'drop' AS kind, t, 1.0::DOUBLE AS v, 1500 AS gap, 400 AS most FROM e WHERE level > 0.6 UNION ALL SELECT user_id, 'kick', t, kick, 110, 4000 FROM e WHERE kick > 0.5),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY t, v) AS n FROM c),
f AS (SELECT user_id, kind, 0::BIGINT AS n, NULL::BIGINT AS last, false AS kept FROM o GROUP BY ALL
  UNION ALL SELECT f.user_id, f.kind, o.n, CASE WHEN last IS NULL OR t - last > gap THEN t ELSE last END, last IS NULL OR t - last > gap FROM f JOIN o ON o.user_id = f.user_id AND o.kind = f.kind AND o.n = f.n + 1),
k AS (SELECT user_id, kind, t::DOUBLE AS t, v FROM f JOIN o USING (user_id, kind, n) WHERE kept QUALIFY row_number() OVER (PARTITION BY user_id, kind ORDER BY n DESC) <= most),
u AS (SELECT user_id FROM k GROUP BY user_id HAVING count(*) FILTER (kind = 'drop') > 0 OR count(*) FILTER (kind = 'kick') >= 8) SELECT * FROM k WHERE user_id IN (SELECT user_id FROM u)""")
def _(spark, sf):
    t = samples(spark, sf).select("user_id", F.col("pos_ms").cast("double").alias("pos_ms"), (F.col("level") > 0.6).alias("drop"), (F.col("bass") * 2).alias("kick"))
    return energy.beat_map(t, "user_id")
