"""Queries of playback, choices, answers in batches, thumb names and page blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import choices, playback
from .registry import Registry, table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql


@_R.add("t8_thumb_name", """SELECT p_partkey, lower(lpad(to_hex(list_reduce(list_concat([1469598103934665603::UBIGINT], list_transform(string_split(p_name, ''), lambda c: ord(c)::UBIGINT)),
  lambda h, b: ((xor(h, b)::HUGEINT * 1099511628211) % 18446744073709551616::HUGEINT)::UBIGINT)), 16, '0')) AS thumb FROM part""")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", names.thumb_name("p_name").alias("thumb"))


@_R.add("t24_containers", """SELECT page_id, array_to_string(list_transform(regexp_extract_all(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), lambda x: trim(x)), '|') AS blocks FROM pages""")
def _(spark, sf):
    """The articles of pages, marked as containers."""
    page = F.replace(F.replace(F.coalesce("html", F.lit("")), F.lit("<article>"), F.lit('<div class="a" data-lyrics-container="true">')), F.lit("</article>"), F.lit("</div>"))
    blocks = F.transform(names.containers(page), lambda x: F.trim(x))
    return table(spark, sf, "pages").select("page_id", F.array_join(blocks, "|").alias("blocks"))


@_R.add("s22_summary", "SELECT user_id, count(*)::BIGINT AS beats, round(max(value), 6) AS loudest, min(event_id) AS first FROM events GROUP BY user_id")
def _(spark, sf):
    """An analysis of each user's events, with the arrays that only a player needs."""
    full = table(spark, sf, "events").groupBy("user_id").agg(
        F.count("*").alias("beats"), F.round(F.max("value"), 6).alias("loudest"), F.min("event_id").alias("first"), F.lit(20).alias("windowMs"), *[F.collect_list("value").alias(n) for n in ("level", "bass", "treble", "onsets")],
    )
    return choices.summary(full)


@_R.add("w10_phase", """WITH s AS (SELECT user_id, min(event_id) AS f, count(*) AS n, sum(cos(event_id % 480 / 480.0::DOUBLE * 2 * pi())) AS re, sum(sin(event_id % 480 / 480.0::DOUBLE * 2 * pi())) AS im FROM events GROUP BY user_id),
p AS (SELECT *, atan2(im, re) / (2 * pi()) * 480 - f AS x FROM s WHERE n >= 8)
SELECT user_id, round(f + x - 480 * floor(x / 480), 3) AS phase_ms, round(sqrt(re * re + im * im) / n, 5) AS confidence FROM p""")
def _(spark, sf):
    found = playback.phase(table(spark, sf, "events"), "user_id", "event_id", 480.0)
    return found.select("user_id", F.round("phase_ms", 3).alias("phase_ms"), F.round("confidence", 5).alias("confidence"))


@_R.add("a21_fired", """
WITH t AS (SELECT event_id % 20 AS k, event_id AS t, event_id * 17 % 40000 AS pos FROM events),
m AS (SELECT p_partkey % 20 AS k, p_partkey * 37 % 40000 AS spot, p_partkey % 7 = 0 AS is_drop, p_size / 50.0::DOUBLE AS strength FROM part),
b AS (SELECT *, lag(pos) OVER (PARTITION BY k ORDER BY t, pos) AS before FROM t),
j AS (SELECT *, before IS NULL OR pos < before OR pos - before > 2000 AS jump FROM b),
c AS (SELECT *, coalesce(lag(jump) OVER (PARTITION BY k ORDER BY t, pos), false) AS closed FROM j),
h AS (SELECT c.k, t, pos, spot, is_drop, strength, spot <= pos AS passed FROM c JOIN m ON c.k = m.k AND NOT jump AND (spot > before OR closed AND spot = before) AND (spot <= pos OR is_drop AND spot - pos < 1800)),
g AS (SELECT k, t, bool_or(passed AND is_drop) AS d, max(strength) FILTER (passed AND NOT is_drop) AS s, min(spot - pos) FILTER (NOT passed) AS wait FROM h GROUP BY k, t)
SELECT c.k, c.t, c.pos, coalesce(d, false) AS drop, coalesce(s, 0.0::DOUBLE) AS kick, round(coalesce(1 - wait / 1800.0::DOUBLE, 0), 6) AS buildup FROM c LEFT JOIN g ON c.k = g.k AND c.t = g.t""")
def _(spark, sf):
    ticks = table(spark, sf, "events").selectExpr("event_id % 20 AS k", "event_id AS t", "event_id * 17 % 40000 AS pos")
    marks = table(spark, sf, "part").selectExpr("p_partkey % 20 AS k", "p_partkey * 37 % 40000 AS at", "if(p_partkey % 7 = 0, 'drop', 'kick') AS kind", "p_size / 50D AS strength")
    return playback.fired(ticks, marks, "k").withColumn("buildup", F.round("buildup", 6))


_MARKED = "c_nationkey AS k, c_name AS name, c_custkey % 11 = 0 AND c_nationkey % 3 = 0 AS favourite, c_custkey % 2 = 0 OR c_nationkey % 5 = 1 AS hidden, c_custkey % 13 = 0 AND c_nationkey % 2 = 0 AS curated, c_custkey % 3 = 0 AS seen"


@_R.add("a23_pool", f"""
WITH i AS (SELECT {_MARKED} FROM customer), a AS (SELECT * FROM i QUALIFY NOT hidden OR bool_and(hidden) OVER (PARTITION BY k)),
n AS (SELECT *, count(*) FILTER (favourite) OVER (PARTITION BY k) AS f, count(*) FILTER (curated) OVER (PARTITION BY k) AS c FROM a)
SELECT k, name FROM n WHERE CASE WHEN f > 1 THEN favourite WHEN c > 0 THEN curated ELSE true END""")
def _(spark, sf):
    return choices.pool(table(spark, sf, "customer").selectExpr(*_MARKED.split(", ")), "k")


@_R.add("a23_shown", f"SELECT name FROM (SELECT {_MARKED} FROM customer) WHERE contains(lower(name), '7') AND NOT seen")
def _(spark, sf):
    return table(spark, sf, "customer").selectExpr(*_MARKED.split(", ")).where(choices.shown(" 7 ", "unseen")).select("name")


@_R.add("j21_contained", """
WITH l AS (SELECT user_id, event_id AS i, event_type AS text, CASE WHEN event_id % 97 <> 0 THEN upper(event_type) END AS reply, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 40 AS batch FROM events)
SELECT user_id, i, batch, CASE WHEN bool_or(reply IS NULL) OVER w THEN text ELSE reply END AS text, NOT bool_or(reply IS NULL) OVER w AND reply <> text AS changed FROM l WINDOW w AS (PARTITION BY user_id, batch)""")
def _(spark, sf):
    lines = table(spark, sf, "events").select("user_id", F.col("event_id").alias("i"), F.col("event_type").alias("text"))
    return choices.contained(lines, lines.where("i % 97 <> 0").withColumn("text", F.upper("text")), "user_id")
