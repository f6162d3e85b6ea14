"""Queries on small made tables that their copies at size resemble: equal rows, long spans, many parts of one name."""

from collections import Counter
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from quaverlake import plans


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def same_as_sql(spark, folder, name):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for f in folder.iterdir():
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}/*.parquet'")
    got, df = db.execute(plans.oracle_sql()[name]), plans.queries()[name](spark, str(folder))
    columns = [d[0] for d in got.description]
    want = Counter(tuple(map(plain, r)) for r in got.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want
    return want


def events(spark, folder, rows):
    made = [(k, datetime(2024, 1, 1) + timedelta(seconds=s), user, kind, value) for k, (s, user, kind, value) in enumerate(rows)]
    spark.createDataFrame(made, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")


def test_m2_last_span_under_a_longer_one(spark, tmp_path):
    events(spark, tmp_path, [(0, 1, "view", 100.0), (290, 1, "view", 1.0), (0, 2, "view", 5.0), (400, 2, "view", 0.0), (7, 3, "view", 2.0)])
    begin = 1_704_067_200  # 2024-01-01; a second of the table is a millisecond of the query
    assert same_as_sql(spark, tmp_path, "m2_pad_spans")[(2, begin + 370, begin + 400)] == 1


def test_s21_is_dealt_over_tasks(spark, sf_dir):
    """A few bytes a user, and much to compute: all users in one task took as long as one core."""
    df = plans.queries()["s21_analysis"](spark, sf_dir)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert df.rdd.getNumPartitions() == n > 1 and df.count() == spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()


def block(spark, folder, n):
    """Parts of one brand and size whose names repeat."""
    rows = [(k, ("hot ring", "red bolt", "hot bolt")[k // 5 % 3], "Brand#1", ("SMALL", "LARGE")[k // 15 % 2], 1 + (k > n - 9), 900.0) for k in range(n)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")


def test_names_are_compared_once_for_two_kinds(spark, tmp_path):
    from quaverlake.plans import matching

    block(spark, tmp_path, 400)
    p = matching.parts(spark, str(tmp_path))
    kinds = [len({r["kind"] for r in p.where(f"p_size = {s}").collect()}) for s in (1, 2)]
    assert matching.alike(p).count() == sum(n * n for n in kinds) < 400 * 400 / 50
    assert len(same_as_sql(spark, tmp_path, "j2_best_synced")) > 300
    for name in ("j1_candidate_scores", "j3_best_plain", "j6_art_pick", "j7_top_candidates"):
        assert same_as_sql(spark, tmp_path, name)


def test_parts_meet_in_blocks_without_a_join(spark, tmp_path, monkeypatch):
    """A table of parts that is small in its file was broadcast, and pairs of kinds were rows of joins. Blocks are dealt out here; some names differ in case only, some are missing."""
    from quaverlake.operators import matching

    names, kinds = ("hot ring", "Hot Ring", "red bolt", None, "hot hot bolt", "small ring"), ("SMALL", "LARGE", None)
    rows = [(k, names[k * 7 % 31 % 6], "Brand#1", kinds[k // 30 % 3], 1 + (k > 290), 900.0) for k in range(300)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(matching, "PIECE", 50)
    for name in ("j1_candidate_scores", "j2_best_synced", "j3_best_plain", "j6_art_pick", "j7_top_candidates"):
        df = plans.queries()[name](spark, str(tmp_path))
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
        assert same_as_sql(spark, tmp_path, name)


def test_names_of_a_block_in_small_matrices(spark, sf_dir, monkeypatch):
    """Kinds a few at a time, against the column functions on pairs of kinds."""
    import pyarrow as pa

    from quaverlake.functions import blocks
    from quaverlake.operators import matching as M
    from quaverlake.plans import matching

    p = matching.parts(spark, sf_dir).where("p_size < 9").withColumns({"p_brand": F.lit("Brand#1"), "p_size": F.lit(1)}).cache()
    wanted = {(r.w_kind.part, r.c_kind.part): (r.like, r.tags, r.art) for r in matching.alike(p).collect()}
    named = M.with_tokens(p, "title", "p_type", "w_").select("part", F.col("kind.part").alias("kind"), *[F.lit(True).alias(c) for c in ("own", "fit")], *[F.lit(1).alias(c) for c in ("wanted_s", "found_s", "turn")],
        F.col("title").alias("name"), F.lower("title").alias("low"), F.col("w_title").alias("t"), F.col("w_raw").alias("r"), F.col("w_artist").alias("a"), F.col("w_full").alias("f"), F.col("w_tags").alias("g"))
    monkeypatch.setattr(blocks, "CELLS", 100)
    b = blocks.Block(named.toArrow().to_batches())
    ids, met = sorted({k for k, _ in wanted}), 0
    for kinds, _ in b.asking(len(ids)):
        (like, tags), art = b.lyrics(kinds), b.art(kinds)
        for i, k in enumerate(ids[kinds]):
            for j, c in enumerate(ids):
                assert (like[i, j], tags[i, j]) == wanted[k, c][:2] and art[i, j] / 1e6 == round(wanted[k, c][2], 6)
                met += 1
    assert met == len(wanted) > 500 and isinstance(next(blocks.all_pairs(b)), pa.RecordBatch)


def test_pages_are_picked_by_tokens_made_once(spark):
    from quaverlake.operators import matching

    rows = [(1, 1, ["a", "b"], ["x"], ["a"], ["x"]), (1, 2, ["a", "b"], ["x"], ["b", "a"], ["x"]), (2, 1, ["c"], ["x"], ["d"], []), (3, 1, None, ["x"], ["d"], ["x"])]
    df = spark.createDataFrame(rows, "k int, ord int, t array<string>, a array<string>, ft array<string>, fa array<string>")
    assert sorted(map(tuple, matching.page_pick(df, "k", "t", "a", "ft", "fa").collect())) == [(1, 2, 3.0), (3, 1, 1.0)]


def test_fired_meets_no_mark_by_a_join(spark):
    """Thousands of kicks between two ticks, against a plain loop; no place of a mark is in a join."""
    import random

    from quaverlake.operators import playback

    r = random.Random(4)
    marks = [(1, r.randrange(20_000) / 4, r.choice(["kick", "kick", "drop"][: 2 + (k % 40 == 0)]), r.random()) for k in range(12_000)]
    pos = [0.0, 10.0, 1990.0, 3990.0, 3990.0, 3000.0, 3100.5, 4900.25]
    df = spark.createDataFrame([(1, t, p) for t, p in enumerate(pos)], "k int, t int, pos double")
    fired = playback.fired(df, spark.createDataFrame(marks, "k int, at double, kind string, strength double"), "k")
    joins = [line for line in fired._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert joins and not any("(at#" in line or "_b#" in line for line in joins)
    got = {x["t"]: (x["drop"], x["kick"], round(x["buildup"], 9)) for x in fired.collect()}
    jumps = [t == 0 or p < pos[t - 1] or p - pos[t - 1] > 2000 for t, p in enumerate(pos)]
    for t, p in enumerate(pos):
        if jumps[t]:
            assert got[t] == (False, 0, 0)
            continue
        met = [m for m in marks if (pos[t - 1] < m[1] or jumps[t - 1] and pos[t - 1] == m[1]) and m[1] <= p]
        wait = min((m[1] - p for m in marks if m[2] == "drop" and 0 < m[1] - p < 1800), default=1800)
        assert got[t] == (any(m[2] == "drop" for m in met), max((m[3] for m in met if m[2] == "kick"), default=0), round(1 - wait / 1800, 9))
