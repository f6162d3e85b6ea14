"""An index of files that is kept up to date by comparing scans, and the journal of unfinished work."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLAGS = ("analyzed", "lyrics_synced")


def diff_index(old: DataFrame, scan: DataFrame) -> DataFrame:
    """old (path, size, modified_ms, flags), scan (path, size, modified_ms) -> the new index plus `change`.

    Unchanged files keep their flags, changed and new ones start without; files that the scan lacks go.
    """
    o = old.select("path", F.col("size").alias("o_size"), F.col("modified_ms").alias("o_modified"), *FLAGS)
    both = scan.select("path", "size", "modified_ms").join(o, "path", "left")
    same = (F.col("size") == F.col("o_size")) & (F.col("modified_ms") == F.col("o_modified"))
    change = F.when(F.col("o_size").isNull(), "added").when(same, "unchanged").otherwise("updated")
    return both.select("path", "size", "modified_ms", *[F.when(same, F.col(f)).otherwise(F.lit(False)).alias(f) for f in FLAGS], change.alias("change"))


def mark_done(index: DataFrame, done: DataFrame, flag: str) -> DataFrame:
    """Sets a flag where size and modified_ms are still those of the work that is done (path, size, modified_ms)."""
    d = done.select("path", "size", "modified_ms", F.lit(True).alias("__done")).distinct()
    out = index.join(d, ["path", "size", "modified_ms"], "left")
    return out.withColumn(flag, F.col(flag) | F.coalesce("__done", F.lit(False))).drop("__done")


def backfill(index: DataFrame) -> DataFrame:
    """One row per path that lacks a flag."""
    return index.where(~(F.col("analyzed") & F.col("lyrics_synced"))).select("path").distinct()


def progress(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("total"), *[F.count_if(f).alias(f) for f in FLAGS])


def folder_progress(index: DataFrame, depth: int = 64) -> DataFrame:
    """Progress of each folder over all files below it: by path parts, so /a/b is not in /a/bc. No join."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    up = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.array_join(F.slice("p", F.lit(1), k), "/"))
    rows = index.withColumn("p", parts).where(F.size("p") > 1).withColumn("folder", F.explode(up))
    return rows.groupBy("folder").agg(F.count("*").alias("total"), *[F.count_if(f).alias(f) for f in FLAGS])


def unfinished(starts: DataFrame, finishes: DataFrame, key: str = "id") -> DataFrame:
    """Starts without a finish of the same id."""
    return starts.join(finishes.select(key).distinct(), key, "left_anti")


def take_stale(starts: DataFrame, finishes: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(starts that are left over, finishes with them): what is taken counts as finished, so that nobody takes it again."""
    taken = unfinished(starts, finishes, key)
    return taken, finishes.select(key).unionByName(taken.select(key))


def retained(log: DataFrame, by: str, order: list[str], size: str, limit: int) -> DataFrame:
    """The newest rows of each log whose sizes sum to at most `limit`."""
    w = Window.partitionBy(by).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("__s", F.sum(size).over(w)).where(F.col("__s") <= limit).drop("__s")


def superseded(runs: DataFrame, by: str, token: str) -> DataFrame:
    """Only the rows of the newest run."""
    return runs.withColumn("__m", F.max(token).over(Window.partitionBy(by))).where(F.col(token) == F.col("__m")).drop("__m")


def dedup_jobs(requests: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of requests with the same key the first is accepted; `accepted` says which."""
    w = Window.partitionBy(key).orderBy(*order)
    return requests.withColumn("accepted", F.row_number().over(w) == 1)


def crash_reports(posts: DataFrame, raw: str = "raw", received: str = "received") -> DataFrame:
    """posts (raw, received) -> (key, kind, message, app_version, os, received): reports of at most 8,192 characters (as UTF-16) that are JSON with a message."""
    rows = posts.where((F.col(raw) != "") & (F.octet_length(F.encode(raw, "UTF-16BE")) <= 2 * 8192)).withColumn("v", F.try_parse_json(raw))

    def text(name: str, most: int, other: str) -> Column:
        own = F.try_variant_get("v", f"$.{name}", "variant")
        return F.coalesce(F.when(F.schema_of_variant(own) == "STRING", F.substring(F.try_variant_get("v", f"$.{name}", "string"), 1, most)), F.lit(other))

    key = F.concat(F.date_format(received, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("-"), F.substring(F.sha2(raw, 256), 1, 8))
    out = rows.select(key.alias("key"), text("kind", 40, "unknown").alias("kind"), text("message", 4000, "").alias("message"), text("appVersion", 40, "").alias("app_version"), text("os", 40, "").alias("os"), F.col(received).alias("received"))
    return out.where("message <> ''")


def listed_reports(reports: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """The oldest reports of the last 90 days, 50 or up to 200."""
    return reports.where(F.col("received") > now - F.expr("INTERVAL 90 DAYS")).orderBy("key").limit(min(200, limit or 50))


def report_page(reports: DataFrame, now: Column, limit: int | None = None, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """(a page of listed_reports(), the cursor of the next page or None): pages follow each other by (received, key).

    The cursor says where a page ended, so a page is a range that reaches the scan, and reports that come in meanwhile shift
    nothing: they are on a later page. Repeated rows are one report. A cursor that isn't one is an error.
    """
    rows = reports.where(F.col("received") > now - F.expr("INTERVAL 90 DAYS"))
    if cursor is not None:
        at, key = json.loads(base64.urlsafe_b64decode(cursor))
        after = F.timestamp_micros(F.lit(int(at)))
        rows = rows.where((F.col("received") >= after) & ((F.col("received") > after) | (F.col("key") > key)))
    page = rows.dropDuplicates(["received", "key"]).orderBy("received", "key").limit(min(200, limit or 50))
    last = page.agg(F.max(F.struct(F.unix_micros("received").alias("at"), "key")).alias("x"), F.count("*").alias("n")).first()
    if last["n"] < min(200, limit or 50):
        return page, None
    return page, base64.urlsafe_b64encode(json.dumps([last["x"]["at"], last["x"]["key"]]).encode()).decode()
