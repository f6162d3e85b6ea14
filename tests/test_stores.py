"""The journal under two takers, the cache of documents, and pages of reports."""

import threading
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quaverlake import sources
from quaverlake.operators import library
from quaverlake.sources import files


def test_two_takers_share_no_job(spark, tmp_path):
    path = str(tmp_path / "journal")
    for g in range(6):
        sources.journal_start(spark.createDataFrame([(f"{g}-{i}", "k", "a", "t", 1, "/x", None, 5) for i in range(4)], sources.JOB), path)
    sources.journal_finish(spark.createDataFrame([("0-1",), ("3-3",)], "id string"), path)
    got, gate = [None, None], threading.Barrier(2)

    def take(k):
        gate.wait()
        got[k] = [r["id"] for r in sources.journal_take(spark, path).collect()]  # a taker that fails leaves None

    takers = [threading.Thread(target=take, args=(k,)) for k in (0, 1)]
    for t in takers:
        t.start()
    for t in takers:
        t.join()
    assert sorted(got[0] + got[1]) == sorted(f"{g}-{i}" for g in range(6) for i in range(4) if (g, i) not in ((0, 1), (3, 3)))
    assert sources.journal_take(spark, path).count() == 0


def test_one_of_many_claims(spark, tmp_path):
    for n in range(40):
        got, gate = [], threading.Barrier(4)

        def claim(n=n):
            gate.wait()
            got.append(files._claimed(spark, str(tmp_path / "claims" / str(n))))

        own = [threading.Thread(target=claim) for _ in range(4)]
        for t in own:
            t.start()
        for t in own:
            t.join()
        assert sorted(got) == [False, False, False, True]


def test_documents_are_merged_on_read(spark, tmp_path):
    path = str(tmp_path / "cache")
    put = lambda rows, schema="k string, v int": sources.put_documents(spark.createDataFrame(rows, schema), path, "k", 16)
    get = lambda k: [r["v"] for r in sources.get_document(spark, path, "k", k).collect()]
    assert sources.get_document(spark, path, "k", "a") is None
    put([(f"key{i}", i) for i in range(200)])
    put([("key3", 33), ("key3", 34), ("new", 1)])
    put([("key4", 44)])
    want = {f"key{i}": i for i in range(200)} | {"key3": 34, "new": 1, "key4": 44}
    whole = lambda: {r["k"]: r["v"] for r in sources.all_documents(spark, path, "k").collect()}
    assert whole() == want and get("key3") == [34] and get("none") == []
    assert len(sources._children(spark, f"{path}/deltas")) == 3
    sources.compact_documents(spark, path, "k")
    assert whole() == want and get("key4") == [44] and sources._children(spark, f"{path}/deltas") == []
    put([("key4", 45, "more")], "k string, v int, extra string")
    sources.compact_documents(spark, path, "k")
    sources.compact_documents(spark, path, "k")
    assert whole() == want | {"key4": 45} and len(sources._children(spark, f"{path}/bases")) == 1
    files = sources.get_document(spark, path, "k", "key7")
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_report_pages_join_to_the_listing(spark):
    now = datetime(2024, 6, 1)
    rows = [(f"k{i:03d}", now - timedelta(days=i % 95, hours=i % 3)) for i in range(300)] + [("k001", now - timedelta(days=1, hours=1))]
    reports = spark.createDataFrame(rows, "key string, received timestamp")
    at, cursor, found = F.lit(now), None, []
    for n in range(40):
        page, cursor = library.report_page(reports, at, 30, cursor)
        own = [(r["received"], r["key"]) for r in page.collect()]
        assert len(own) <= 30
        found += own
        if n == 2:
            reports = reports.unionByName(spark.createDataFrame([("late", now)], "key string, received timestamp"))
        if cursor is None:
            break
    want = sorted({(t, k) for k, t in [*rows, ("late", now)] if t > now - timedelta(days=90)})
    assert found == want and n >= 9
    plan = library.report_page(reports, at, 30, None)[0]
    assert library.report_page(reports.limit(0), at)[1] is None and plan.count() == 30
