"""Playback, choices, answers in batches, thumb names, page blocks, polls and spectra on small cases."""

import numpy as np
from pyspark.sql import functions as F

from quaverlake.functions import kernels, names
from quaverlake.operators import choices, library, playback, signal
from quaverlake.streaming import Polls, over_table


def test_fired(spark):
    ticks = spark.createDataFrame([(1, 0, 1000), (1, 1, 1500), (1, 2, 2000), (1, 3, None), (1, 4, 9000), (1, 5, 9100), (1, 6, 8000)], "k int, t int, pos int")
    marks = spark.createDataFrame([(1, 1000, "kick", 0.5), (1, 1500, "kick", 0.9), (1, 2000, "drop", None), (1, 5000, "drop", None), (1, 9000, "drop", None), (2, 1400, "kick", 1.0)], "k int, at int, kind string, strength double")
    got = {r["t"]: (r["drop"], r["kick"], round(r["buildup"], 4)) for r in playback.fired(ticks, marks, "k").collect()}
    # the mark at the first tick's position is fired by the second; the jump to 9000 fires nothing, the tick behind it does
    assert got == {0: (False, 0, 0), 1: (False, 0.9, round(1 - 500 / 1800, 4)), 2: (True, 0, 0), 4: (False, 0, 0), 5: (True, 0, 0), 6: (False, 0, 0)}
    assert playback.fired(ticks.limit(0), marks, "k").count() == 0 and playback.fired(ticks, marks.limit(0), "k").count() == 6


def test_phase(spark):
    df = spark.createDataFrame([(1, 1030 + 500 * i) for i in range(9)] + [(2, 5)], "k int, t long")
    (r,) = playback.phase(df, "k", "t", 500.0).collect()
    assert (r["phase_ms"] - 1030) % 500 < 1e-6 or (r["phase_ms"] - 1030) % 500 > 500 - 1e-6
    assert abs(r["confidence"] - 1) < 1e-9 and playback.phase(df, "k", "t", 0.0).count() == 0


def test_pool_and_shown(spark):
    rows = [(1, "a", True, True, False), (1, "b", True, True, True), (2, "c", True, False, False), (2, "d", False, False, True), (2, "e", True, True, False), (3, "f", True, False, False), (3, "g", False, False, False), (4, "h", True, False, False), (4, "i", True, False, False), (4, "j", False, False, True)]
    df = spark.createDataFrame(rows, "k int, name string, favourite boolean, hidden boolean, curated boolean")
    assert sorted(map(tuple, choices.pool(df, "k").collect())) == [(1, "a"), (1, "b"), (2, "d"), (3, "f"), (3, "g"), (4, "h"), (4, "i")]
    seen = df.withColumn("seen", F.col("name") < "d")
    names_of = lambda *a: sorted(r["name"] for r in seen.where(choices.shown(*a)).collect())
    assert names_of() == list("cdfghij") and names_of("B") == ["b"] and names_of("", "unseen") == list("dfghij") and names_of("", "fav") == list("abcefhi")


def test_contained(spark):
    lines = spark.createDataFrame([(k, i, f"x{i}") for k in (1, 2) for i in range(5)], "k int, i int, text string")
    answers = spark.createDataFrame([(1, i, f"y{i}") for i in (0, 1, 2)] + [(2, i, f"z{i}") for i in range(5)], "k int, i int, text string")
    got = {(r["k"], r["i"]): (r["batch"], r["text"]) for r in choices.contained(lines, answers, "k", 2).collect()}
    assert [got[1, i] for i in range(5)] == [(0, "y0"), (0, "y1"), (1, "x2"), (1, "x3"), (2, "x4")]
    whole = choices.contained(lines, answers, "k", 2, whole=True).collect()
    assert {(r["k"], r["text"]) for r in whole} == {(2, f"z{i}") for i in range(5)}


def test_thumb_names_and_blocks(spark):
    df = spark.createDataFrame([("",), ("a",), (None,), ("é",)], "n string")

    def plain(text):
        h = 1469598103934665603
        for b in text.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        return f"{h:016x}"

    assert [r[0] for r in df.select(names.thumb_name("n")).collect()] == [None if r["n"] is None else plain(r["n"]) for r in df.collect()]
    mark = '<div data-lyrics-container="true">'
    assert names.inner_blocks(f"{mark}a<div>b</div>c</div><div>d</div>{mark}{mark}e</div>f") == ["a<div>b</div>c", f"{mark}e</div>f"]
    assert names.inner_blocks("") == [] and names.inner_blocks("<div>x</div>") == []


def test_summary_and_polls(spark):
    df = spark.createDataFrame([(1, 2, 3)], "beats int, level int, windowMs int")
    assert choices.summary(df).columns == ["beats"]
    rows = [(1, 0, "p", "A", False), (1, 250, "p", "B", False), (1, 500, None, None, True), (1, 1000, "p", "B", False), (1, 1250, "q", "C", False), (1, 1500, None, None, False), (1, 1750, "q", "D", False)]
    got = over_table(spark.createDataFrame(rows, "k int, t long, app string, title string, failed boolean"), Polls(), "k").orderBy("t").collect()
    assert [(r["t"], r["title"], r["fresh"]) for r in got] == [(0, "A", True), (250, "A", False), (1000, "B", True), (1250, "C", True), (1500, None, False), (1750, "D", True)]


def test_spectra(spark):
    tone = np.sin(2 * np.pi * 64 * np.arange(1024) / 1024)
    levels = kernels.shown_spectra(np.stack([tone, tone * 0.5, np.zeros(1024)]))
    assert levels[0].argmax() == 64 and levels[0].max() == 255 and levels[2].max() < levels[1].max()
    df = spark.createDataFrame([(1, 1, (tone * 0.5).tolist()), (1, 0, tone.tolist()), (1, 2, [0.0] * 1024), (2, 0, [1.0])], "k int, t int, samples array<double>")
    got = signal.spectra(df, "k").orderBy("t").collect()
    assert [r["levels"] for r in got] == levels.tolist()
    assert kernels.shown_spectra(np.zeros((0, 1024))).shape == (0, 512)


def test_bands_and_flux(spark):
    r = np.random.default_rng(2)
    a, b = ([float(v) for v in r.integers(0, 256, 512)] for _ in range(2))
    df = spark.createDataFrame([(1, a, b), (2, a[:20], b[:20])], "k int, a array<double>, b array<double>")
    got = {x["k"]: x for x in df.select("k", signal.bands(F.col("a")).alias("bands"), signal.flux(F.col("a"), F.col("b"), 2, 8).alias("part"), signal.flux(F.col("a"), F.col("b"), 4).alias("rest")).collect()}
    edges = (0, 2, 4, 8, 16, 32, 72, 160, 512)
    for k, n in ((1, 512), (2, 20)):
        assert np.allclose(got[k]["bands"], [np.mean(a[i : min(j, n)]) / 255 if i < n else 0 for i, j in zip(edges, edges[1:])])
        rise = np.maximum(0, np.subtract(a[:n], b[:n]))
        assert np.isclose(got[k]["part"], rise[2:8].mean()) and np.isclose(got[k]["rest"], rise[4:].mean())


def test_attribution(spark):
    actors = [("Seedhe Maut", "Calm"), ("Seedhe Maut", "Encore"), (None, " Karun\t")]
    cases = [(0, actors, ["karun", " SEEDHE MAUT "], [0, 1, -1, 2, None]), (1, actors, ["x", "y"], [0, 1]), (2, actors, ["karun"], [0]), (3, [], ["karun", "x"], [0]), (4, actors, ["encore", ""], [0, 1]), (5, actors, ["karun", "x"], [])]
    df = spark.createDataFrame(cases, "k int, actors array<struct<credit:string,name:string>>, artists array<string>, singers array<int>")
    got = {r["k"]: r["x"] for r in df.select("k", choices.map_attribution(F.col("actors"), F.col("artists"), F.col("singers")).alias("x")).collect()}
    assert got == {0: [2, 0, -1, -1, -1], 1: None, 2: None, 3: None, 4: [1, -1], 5: None}


def test_crash_reports(spark):
    pad = lambda n: '{"message": "' + "m" * n + '"}'
    posts = ['{"kind": "' + "k" * 50 + '", "message": "boom", "appVersion": 7, "os": "' + "o" * 41 + '"}', pad(5000), pad(8192 - 15), pad(8192 - 14), "broken", "", None, "[1]", '{"message": 5}', '{"message": ""}', '{"message": "old"}']
    df = spark.createDataFrame([(i, p) for i, p in enumerate(posts)], "i int, raw string").withColumn("received", F.timestamp_seconds(F.when(F.col("i") == 10, 0).otherwise(10_000_000) + F.col("i")))
    kept = library.crash_reports(df)
    rows = [r for r in kept.orderBy("key").collect()]
    assert [(len(r["message"]), r["kind"], r["app_version"]) for r in rows] == [(3, "unknown", ""), (4, "k" * 40, ""), (4000, "unknown", ""), (4000, "unknown", "")] and rows[1]["os"] == "o" * 40
    now = F.timestamp_seconds(F.lit(10_000_100))
    assert [r["key"] for r in library.listed_reports(kept, now).collect()] == [r["key"] for r in rows[1:]]
    assert library.listed_reports(kept, now, 2).count() == 2
