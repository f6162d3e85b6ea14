"""Queries of the index and the journal: orders stand for files, line items for finished work."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import library
from .registry import Registry, table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql
_PATH = "'/' || o_orderstatus || '/' || o_orderpriority || '/' || o_orderkey || '.flac'"
_OLD = f"SELECT {_PATH} AS path, o_custkey AS size, o_orderkey * 1000 AS modified_ms, o_orderkey % 3 = 0 AS analyzed, o_orderkey % 5 = 0 AS lyrics_synced FROM orders WHERE o_orderkey % 7 <> 0"
_SCAN = f"SELECT {_PATH} AS path, o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS size, o_orderkey * 1000 AS modified_ms FROM orders WHERE o_orderkey % 13 <> 0"
_NEW = f"""o AS ({_OLD}), s AS ({_SCAN}), n AS (SELECT s.*, coalesce(o.size = s.size AND o.modified_ms = s.modified_ms, false) AS same, o.path IS NULL AS fresh, o.analyzed AS a, o.lyrics_synced AS l FROM s LEFT JOIN o USING (path)),
i AS (SELECT path, size, modified_ms, same AND coalesce(a, false) AS analyzed, same AND coalesce(l, false) AS lyrics_synced, CASE WHEN fresh THEN 'added' WHEN same THEN 'unchanged' ELSE 'updated' END AS change FROM n)"""


def index(spark, sf):
    path = F.format_string("/%s/%s/%d.flac", "o_orderstatus", "o_orderpriority", "o_orderkey").alias("path")
    o, stamp = table(spark, sf, "orders"), (F.col("o_orderkey") * 1000).alias("modified_ms")
    old = o.where("o_orderkey % 7 <> 0").select(path, F.col("o_custkey").alias("size"), stamp, (F.col("o_orderkey") % 3 == 0).alias("analyzed"), (F.col("o_orderkey") % 5 == 0).alias("lyrics_synced"))
    size = F.col("o_custkey") + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0)
    return library.diff_index(old, o.where("o_orderkey % 13 <> 0").select(path, size.alias("size"), stamp))


@_R.add("a5_diff_index", f"WITH {_NEW} SELECT * FROM i")
def _(spark, sf):
    return index(spark, sf)


@_R.add("a3_progress", f"WITH {_NEW} SELECT count(*)::BIGINT AS total, count(*) FILTER (analyzed)::BIGINT AS analyzed, count(*) FILTER (lyrics_synced)::BIGINT AS lyrics_synced FROM i")
def _(spark, sf):
    return library.progress(index(spark, sf))


@_R.add("a4_folders", f"""WITH {_NEW}, p AS (SELECT *, string_split(substr(path, 2), '/') AS p FROM i), f AS (SELECT *, unnest([p[1], p[1] || '/' || p[2]]) AS folder FROM p)
SELECT folder, count(*)::BIGINT AS total, count(*) FILTER (analyzed)::BIGINT AS analyzed, count(*) FILTER (lyrics_synced)::BIGINT AS lyrics_synced FROM f GROUP BY folder""")
def _(spark, sf):
    return library.folder_progress(index(spark, sf))


@_R.add("a6_mark_done", f"WITH {_NEW} SELECT path, analyzed OR modified_ms % 17000 = 0 AS analyzed FROM i")
def _(spark, sf):
    i = index(spark, sf)
    done = i.where("modified_ms % 17000 = 0").select("path", "size", "modified_ms")
    return library.mark_done(i, done, "analyzed").select("path", "analyzed")


@_R.add("a7_backfill", f"WITH {_NEW} SELECT DISTINCT path FROM i WHERE NOT (analyzed AND lyrics_synced)")
def _(spark, sf):
    return library.backfill(index(spark, sf))


@_R.add("a8_list_synced", "SELECT p_partkey, p_name, lower(p_name) AS sort_key FROM part WHERE p_name <> '' AND p_size > 0 AND p_type = 'ECONOMY'")
def _(spark, sf):
    t = table(spark, sf, "part").where("p_name <> '' and p_size > 0 and p_type = 'ECONOMY'")
    return t.select("p_partkey", "p_name", F.lower("p_name").alias("sort_key")).orderBy("sort_key", "p_partkey")


@_R.add("j5_unfinished", "SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def _(spark, sf):
    starts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    return library.unfinished(starts, table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("id")))


_DONE = "SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F'"


@_R.add("io12_take_stale", f"""WITH a AS (SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderdate < DATE '1995-01-01' AND o_orderkey NOT IN ({_DONE}))
SELECT 1 AS session, * FROM a UNION ALL SELECT 2, o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN ({_DONE}) AND o_orderkey NOT IN (SELECT id FROM a)""")
def _(spark, sf):
    """Two sessions take what is left over: the second one only what has started since."""
    starts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate")
    done = table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("id")).distinct()
    first, done = library.take_stale(starts.where("o_orderdate < DATE '1995-01-01'"), done)
    second, _ = library.take_stale(starts, done)
    return first.withColumn("session", F.lit(1)).unionByName(second.withColumn("session", F.lit(2))).select("session", "id", "o_custkey")


@_R.add("io25_retained", "SELECT user_id, event_id FROM (SELECT *, sum(length(props)) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS s FROM events) WHERE s <= 256")
def _(spark, sf):
    t = table(spark, sf, "events").withColumn("size", F.length("props"))
    return library.retained(t, "user_id", ["ts", "event_id"], "size", 256).select("user_id", "event_id")


@_R.add("w15_superseded", "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY l_partkey = max(l_partkey) OVER (PARTITION BY l_orderkey)")
def _(spark, sf):
    return library.superseded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_partkey").select("l_orderkey", "l_linenumber")


@_R.add("x1_dedup_jobs", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS accepted FROM events")
def _(spark, sf):
    t = table(spark, sf, "events").withColumn("job", F.concat_ws(":", "user_id", "event_type"))
    return library.dedup_jobs(t, "job", ["ts", "event_id"]).select("event_id", "accepted")


@_R.add("io8_stale_files", f"WITH i AS ({_SCAN}) SELECT path FROM i WHERE starts_with(path, '/F/') AND modified_ms <= (SELECT max(modified_ms) FROM i) - 3600 * 1000")
def _(spark, sf):
    """Files of a folder that are an hour older than the newest of all: as many as the table brings."""
    i = index(spark, sf)
    newest = i.agg(F.max("modified_ms").alias("newest"))  # one row
    return i.where(F.startswith(F.col("path"), F.lit("/F/"))).join(F.broadcast(newest), F.col("modified_ms") <= F.col("newest") - 3600 * 1000).select("path")
