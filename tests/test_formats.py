"""Chunks of recordings against whole arrays; formats of samples, frames and a watched folder; late samples."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaverlake import sources
from quaverlake.operators import chunks as C
from quaverlake.operators import playback, signal
from quaverlake.streaming import Easing, Recorder, RecordSlot, over_table


def recordings(spark, tmp_path, lengths, chunk, seed=1):
    r = np.random.default_rng(seed)
    own = {}
    for k, n in enumerate(lengths):
        own[f"{k}.pcm"] = r.random(n).astype("<f4")
        (tmp_path / f"{k}.pcm").write_bytes(own[f"{k}.pcm"].tobytes())
    df = sources.read_chunks(spark, str(tmp_path), 44_100, chunk, split=16 * chunk)
    return own, df.withColumn("key", F.element_at(F.split("path", "/"), -1))


def whole(df, value="samples"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["key"], r["chunk_no"])):
        out.setdefault(r["key"], []).extend(r[value])
    return {k: np.array(v) for k, v in out.items()}


def test_chunks_are_read_by_ranges(spark, tmp_path):
    own, df = recordings(spark, tmp_path, [1, 7, 1000, 4096], 16)
    (tmp_path / "none.pcm").write_bytes(b"")
    (tmp_path / "odd.pcm").write_bytes(b"abcde")
    df = sources.read_chunks(spark, str(tmp_path), 44_100, 16, split=256).withColumn("key", F.element_at(F.split("path", "/"), -1))
    got = whole(df.where("error is null"))
    assert {k: v.tolist() for k, v in got.items()} == {k: v.tolist() for k, v in own.items()}
    assert {r["key"]: r["error"] for r in df.where("error is not null").collect()} == {"none.pcm": "empty", "odd.pcm": "size isn't a multiple of 4"}
    assert df.rdd.getNumPartitions() > 60 and df.agg(F.max(F.size("samples"))).first()[0] == 16


def follower(x, share):
    y, out = 0.0, []
    for v in x:
        y += share * (v - y)
        out.append(y)
    return np.array(out)


def test_chunks_are_as_whole_recordings(spark, tmp_path):
    """A minute at 44.1 kHz and shorter ones: followers, onsets and both resamplings, to 1e-9."""
    own, df = recordings(spark, tmp_path, [60 * 44_100, 5000, 257, 256, 1], 4096)
    df = df.where("error is null")
    got = whole(C.follow(df, "key", 0.1))
    assert all(np.abs(got[k] - follower(x.astype(float), 0.1)).max() < 1e-9 for k, x in own.items())
    for to in (16_000, 48_000):
        got, near = whole(C.resample_linear(df, "key", to)), whole(C.resample_nearest(df, "key", to))
        for k, x in own.items():
            n = int(len(x) * to / 44_100 + 0.5)
            place = np.arange(n) * 44_100 / to
            assert len(got.get(k, [])) == n and (not n or np.abs(got[k] - np.interp(place, np.arange(len(x)), x.astype(float))).max() < 1e-9)
            n = len(x) * to // 44_100
            assert near.get(k, np.array([])).tolist() == x[np.arange(n) * 44_100 // to].astype(float).tolist()


def test_chunk_onsets_are_as_whole_recordings(spark):
    r = np.random.default_rng(5)
    rows = [(k, (np.abs(r.standard_normal(n)) * r.choice([0.05, 0.3, 1.0])).tolist()) for k, n in enumerate([0, 1, 5, 64, 300, 1000])] + [(None, [0.0, 1.0, 0.0, 1.0] * 20), (99, None)]
    df = spark.createDataFrame(rows, "key long, samples array<double>")
    want = {(r["key"], int(t)) for r in df.select("key", signal.onsets(F.col("samples"), 1.0).alias("t")).collect() for t in r["t"] or []}
    for chunk in (1, 7, 64, 4096):
        got = C.onsets(C.cut_arrays(df, "key", "samples", 44, chunk), "key").collect()
        assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_samples_are_written_at_once(spark, tmp_path):
    rows = [(k, [float(k), 0.5] * (k % 3)) for k in range(20)]
    df = spark.createDataFrame(rows, "key string, samples array<float>").repartition(5)
    sources.write_samples(df, str(tmp_path / "a"))
    sources.write_samples(df, f"file://{tmp_path}/a")
    names = os.listdir(tmp_path / "a")
    assert len(names) == 20 and all(n.endswith(".pcm") for n in names)
    back = {r["path"].split("/")[-1]: r for r in sources.read_chunks(spark, str(tmp_path / "a")).collect()}
    name = lambda k: spark.range(1).select(sources.pcm_name(F.lit(k))).first()[0]
    assert back[name("7")]["samples"] == [7.0, 0.5] and back[name("6")]["error"] == "empty"
    sources.write_samples(df.where("key = '1'"), str(tmp_path / "a"), overwrite=True)
    assert os.listdir(tmp_path / "a") == [name("1")]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    bad = spark.range(40).repartition(8, "id").select(F.col("id").cast("string").alias("key"), F.expr("array(if(id = 31, raise_error('lost'), 1.0))").cast("array<double>").alias("samples"))
    (tmp_path / "a").mkdir()
    with pytest.raises(Exception, match="lost"):
        sources.write_samples(bad, str(tmp_path / "a"))
    assert os.listdir(tmp_path / "a") == []


def test_frames_are_read_in_ranges(spark, tmp_path):
    r = np.random.default_rng(2)
    frames = [(int(r.integers(0, 4)), r.bytes(int(r.integers(0, 400)))) for _ in range(500)]
    data = b"".join(sources.framed(*f) for f in frames)
    (tmp_path / "a.bin").write_bytes(data)
    (tmp_path / "cut.bin").write_bytes(data[:1000] + b"\1")
    (tmp_path / "zero.bin").write_bytes(sources.framed(3, b"x") + struct.pack("<I", 0) + b"rest")
    (tmp_path / "tail.bin").write_bytes(sources.framed(3, b"x") + b"\1\0")
    (tmp_path / "none.bin").write_bytes(b"")
    df = sources.read_frames(spark, str(tmp_path), split=4096)
    assert df.rdd.getNumPartitions() > 15
    own = df.withColumn("name", F.element_at(F.split("path", "/"), -1))
    got = [(r["kind"], bytes(r["payload"])) for r in own.where("name = 'a.bin'").orderBy("at").collect()]
    assert got == frames
    errors = {r["name"]: r["error"] for r in own.where("error is not null").collect()}
    assert errors == {"cut.bin": "bad frame length", "zero.bin": "bad frame length", "tail.bin": "cut frame"}
    some = own.where("kind in (1, 2) and name = 'a.bin'")
    assert some.count() == sum(k in (1, 2) for k, _ in frames) and own.where("kind = 3").where("name = 'zero.bin'").count() == 1


def test_folder_changes_across_a_restart(spark, tmp_path):
    folder = tmp_path / "music"
    (folder / "deep").mkdir(parents=True)

    def run():
        out = []
        q = sources.folder_changes(spark, str(folder), str(tmp_path / "state")).writeStream.foreachBatch(lambda df, n: out.extend((os.path.basename(r["path"]), r["size"], r["change"]) for r in df.collect()))
        q = q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted(out)

    for name in ("a.mp3", "deep/b.OGG", "deep/c.txt"):
        (folder / name).write_bytes(b"123")
    assert run() == [("a.mp3", 3, "added"), ("b.OGG", 3, "added")]
    assert run() == []
    (folder / "a.mp3").write_bytes(b"12345")
    (folder / "deep/b.OGG").unlink()
    (folder / "new.wav").write_bytes(b"")
    assert run() == [("a.mp3", 5, "changed"), ("b.OGG", 3, "removed"), ("new.wav", 0, "added")]
    assert run() == [] and len(os.listdir(tmp_path / "state")) <= 2


def test_window_forms_are_the_machines(spark):
    """Easing, the recorder and the record slot as windows and scans give what the machines give, in any blocks."""
    r = np.random.default_rng(9)
    rows = [(k, int(t), float(r.random() * 1.5), float(r.random()), int(r.integers(0, 6)), int(r.choice([8, 8, 16])), str(r.choice(["start", "start", "stop", "flush"])), str(r.choice(["a", "b", "c"]))) for k in (1, 2, None) for t in np.cumsum(r.integers(1, 300, 150))]
    df = spark.createDataFrame(rows, "k long, t long, rise double, imminence double, samples long, rate long, action string, item string")
    want = {(x["k"], x["t"]): x["eased"] for x in over_table(df, Easing(), "k").collect()}
    for block in (1, 1000, 10**9):
        got = {(x["k"], x["t"]): x["eased"] for x in C.eased(df, "k", 260.0, block).collect()}
        assert got.keys() == want.keys() and max(abs(got[x] - want[x]) for x in want) < 1e-12
    plain = lambda d, *c: sorted(str(tuple(x[n] for n in ("k", "t", *c))) for x in d.collect())
    assert plain(playback.recorded(df, "k", ["t"], 20), "kept", "total", "full") == plain(over_table(df, Recorder(20), "k"), "kept", "total", "full")
    assert plain(playback.record_slot(df, "k", ["t"]), "event", "item") == plain(over_table(df, RecordSlot(), "k"), "event", "item")


def test_native_measures_are_the_kernels(spark):
    """Periods and peaks inside Catalyst, and envelopes of chunks, against arrays in numpy."""
    from quaverlake.functions import kernels as K

    r = np.random.default_rng(3)
    curves = [(k, np.round(np.abs(r.standard_normal(n)) + (np.arange(n) % 9 == 0), 2).tolist()) for k, n in enumerate([0, 1, 2, 3, 39, 40, 41, 120, 400])] + [(90, [0.0] * 60), (91, [1.0, 2.0, 2.0, 1.0, 5.0, 1.0])]
    df = spark.createDataFrame([*curves, (None, None)], "k long, c array<double>")
    got = {x["k"]: (x["frames"], x["confidence"]) for x in signal.periods(df, "k", "c", 20.0).collect()}
    for k, c in curves:
        want = K.period(np.array(c), 20.0)
        assert got[k] == (None, None) if want is None else got[k][0] == want[0] and abs(got[k][1] - want[1]) < 1e-9, k
    got = {x["k"]: x["places"] for x in signal.peaks(df, "k", "c", 4, 0.5).collect()}
    assert got == {k: K.peaks(np.array(c), 4, 0.5) for k, c in curves} | {None: []}
    waves = [(k, r.standard_normal(n).tolist()) for k, n in enumerate([0, 22, 23, 24, 500, 1000])]
    df = spark.createDataFrame(waves, "k long, samples array<double>")
    found = C.envelopes(C.cut_arrays(df, "k", "samples", 1000, 37), "k", 1000).collect()
    for k, x in waves:
        want = K.envelopes(np.array(x), 1000) if x else np.zeros((3, 0))
        own = np.array([[f["level"], f["bass"], f["treble"]] for f in sorted(found, key=lambda f: f["place"]) if f["k"] == k]).reshape(-1, 3)
        assert own.shape == want.T.shape and np.allclose(own, want.T, atol=1e-9)
