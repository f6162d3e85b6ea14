"""Queries of parsed records, grafted words, palettes and playback positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import palettes, wording
from . import sequences
from .registry import Registry, table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql


@_R.add("t21_recording", """SELECT c_custkey, c_name AS title, c_mktsegment || ' feat. N' || c_nationkey AS artist, (c_custkey * 1237 + 500) // 1000 AS duration_s
FROM customer WHERE c_custkey % 7 <> 0""")
def _(spark, sf):
    """Every seventh recording has a blank title; second names are only on the nested artist."""
    body = F.expr("""to_json(named_struct('title', if(c_custkey % 7 = 0, ' ', c_name), 'length', c_custkey * 1237, 'artist-credit', array(
      named_struct('name', c_mktsegment, 'joinphrase', ' feat. ', 'artist', named_struct('name', 'x')),
      named_struct('name', cast(null AS string), 'joinphrase', ' ', 'artist', named_struct('name', 'N' || c_nationkey)))))""")
    return table(spark, sf, "customer").select("c_custkey", R.recording(body).alias("r")).where("r is not null").select("c_custkey", "r.*")


@_R.add("t22_identified", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'bad key' WHEN 1 THEN 'response has no status' END AS error,
  CASE WHEN p_partkey % 5 > 1 THEN p_size / 100.0::DOUBLE END AS score, CASE WHEN p_partkey % 5 > 1 THEN p_name END AS mbid, CASE WHEN p_partkey % 5 > 1 THEN p_type END AS title,
  CASE WHEN p_partkey % 5 > 1 THEN p_brand END AS artists FROM part""")
def _(spark, sf):
    body = F.expr("""to_json(named_struct('status', case p_partkey % 5 when 0 then 'error' when 1 then null else 'ok' end, 'error', named_struct('message', 'bad key'), 'results', array(
      named_struct('score', p_size / 100D, 'recordings', array(named_struct('id', p_name, 'title', ' ' || p_type, 'artists', array(named_struct('name', p_brand || ' '), named_struct('name', ' '))),
      named_struct('id', cast(null AS string), 'title', 'no id', 'artists', array(named_struct('name', p_brand), named_struct('name', p_brand))))))))""")
    found = table(spark, sf, "part").select("p_partkey", R.identified(body).alias("r"))
    found = found.select("p_partkey", "r.error", F.explode_outer("r.candidates").alias("c"))
    return found.select("p_partkey", "error", "c.score", "c.mbid", "c.title", F.array_join("c.artists", ",").alias("artists"))


@_R.add("t34_needs_shaping", r"""SELECT doc_id, regexp_matches(coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN 'क' ELSE '' END,
  '[\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0900}-\x{0DFF}\x{0E00}-\x{0E7F}]') AS shaping FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.needs_shaping(F.expr("coalesce(text, '') || if(doc_id % 3 = 0, 'क', '')")).alias("shaping"))


@_R.add("w4_position", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN event_id * 10 + 250 ELSE event_id * 10 END AS position_ms FROM events")
def _(spark, sf):
    status = F.when(F.col("user_id") % 2 == 0, "Playing").otherwise("Paused")
    return table(spark, sf, "events").select("event_id", R.position_now(status, F.col("event_id") * 10, F.lit(250)).alias("position_ms"))


@_R.add("a22_palette", """
WITH p AS (SELECT user_id, event_id * 37 % 256 AS r, event_id * 91 % 256 AS g, user_id * 53 % 256 AS b, 255 - event_id % 3 * 100 AS a FROM events),
c AS (SELECT user_id, (r >> 5) * 64 + (g >> 5) * 8 + (b >> 5) AS cell, count(*) AS n, sum(CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b)::DOUBLE END) AS v,
  sum(r) AS r, sum(g) AS g, sum(b) AS b FROM p WHERE a >= 128 AND (r + g + b) / 3.0 BETWEEN 28 AND 238 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(n * 0.35::DOUBLE + v, 9) DESC, cell) - 1 AS rank, count(*) OVER (PARTITION BY user_id) AS cells FROM c)
SELECT user_id, rank, printf('#%02x%02x%02x', floor(r / n + 0.5)::BIGINT, floor(g / n + 0.5)::BIGINT, floor(b / n + 0.5)::BIGINT) AS colour, round(n * 0.35::DOUBLE + v, 6) AS score FROM k WHERE cells >= 2 AND rank < 4""")
def _(spark, sf):
    pixels = table(spark, sf, "events").selectExpr("user_id", "event_id * 37 % 256 AS r", "event_id * 91 % 256 AS g", "user_id * 53 % 256 AS b", "255 - event_id % 3 * 100 AS a")
    return palettes.palette(pixels, "user_id").withColumn("score", F.round("score", 6))


@_R.add("j19_attach_words", """
WITH w AS (SELECT p_partkey, list_filter(regexp_split_to_array(p_name, '\\s+'), lambda x: x <> '') AS ws FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'old' ELSE array_to_string(list_transform(ws, lambda x, i: x || '@' || (i - 1) * 100), ' ') END AS words FROM w""")
def _(spark, sf):
    """Names of parts as lines that have words already; of every third a word less was heard."""
    part = table(spark, sf, "part")
    lines = part.selectExpr("p_partkey", "0 AS line_no", "p_name AS text", "array(named_struct('word', 'old', 'start_ms', cast(null AS int), 'end_ms', cast(null AS int))) AS words")
    heard = F.transform(wording.words_of(F.col("p_name")), lambda w, i: F.struct(F.lit("?").alias("word"), (i * 100).alias("start_ms"), (i * 100 + 90).alias("end_ms")))
    short = F.when(F.col("p_partkey") % 3 == 0, F.slice(heard, 1, F.size(heard) - 1)).otherwise(heard)
    out = wording.attach_words(lines, part.select("p_partkey", F.lit(0).alias("line_no"), short.alias("heard")), "p_partkey")
    return out.select("p_partkey", F.array_join(F.transform("words", lambda w: F.concat(w["word"], F.coalesce(F.concat(F.lit("@"), w["start_ms"].cast("string")), F.lit("")))), " ").alias("words"))


@_R.add("a28_outcome", f"""SELECT conv_id, CASE WHEN n % 2 = 0 AND last > 55000 THEN 'already synced' WHEN n % 2 = 0 AND matched > 2 THEN 'words added' WHEN n % 2 = 0 THEN 'no anchors'
  WHEN coverage >= 0.35 THEN 'aligned' WHEN matched < n THEN 'corrected' ELSE 'heard' END AS outcome
FROM (SELECT conv_id, count(*) AS n, max(time_ms) AS last, count(*) FILTER (cue_no >= 0) AS matched, max(coverage) AS coverage FROM ({sequences.SQL["j16_align_lines"]}) GROUP BY conv_id)""")
def _(spark, sf):
    """What becomes of dialogues, by how much of each could be aligned with what was heard of it."""
    found = sequences.QUERIES["j16_align_lines"](spark, sf).groupBy("conv_id").agg(
        F.count("*").alias("n"), F.max("time_ms").alias("last"), F.count_if(F.col("cue_no") >= 0).alias("matched"), F.max("coverage").alias("coverage"),
    )
    n, matched = F.col("n"), F.col("matched")
    return found.select("conv_id", wording.outcome(n % 2 == 0, F.col("last") > 55_000, matched - 2, F.col("coverage"), n - matched).alias("outcome"))
