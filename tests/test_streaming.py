"""Streams give what tables give; files are read as they were written."""

import hashlib
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaverlake import sources
from quaverlake.streaming import Changes, Easing, Envelope, PhaseLock, PriorTempoLock, RecordSlot, Recorder, TempoLock, over_stream, over_table


def samples(spark):
    r = np.random.default_rng(3)
    rows = [(k, i * 20, float(r.random()), float(r.random()), float(r.random()), "abc"[i // 40 % 3] if i % 50 < 45 else None) for i in range(300) for k in (1, 2)]
    return spark.createDataFrame(rows, "k long, t long, bass double, treble double, level double, item string")


@pytest.mark.parametrize("machine", [Changes(), Envelope()])
def test_stream_is_table(spark, tmp_path, machine):
    df = samples(spark)
    for n in range(3):
        df.where((F.col("t") >= n * 2000) & (F.col("t") < (n + 1) * 2000)).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    name = f"out_{type(machine).__name__}"
    q = over_stream(stream, machine, "k").writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(str, spark.table(name).collect()))
    assert got == sorted(map(str, over_table(df, machine, "k").collect())) and got


def fold(machine, rows):
    state, out = machine.start(), []
    for r in rows:
        state, more = machine.step(state, r)
        out += more
    return out


def test_machines():
    assert [x[1] for x in fold(Changes(), [(0, "a"), (1, "a"), (2, None), (3, None), (4, "b")])] == ["track", "tick", "tick", "idle", "track", "tick"]
    assert [x[1:] for x in fold(RecordSlot(), [(0, "start", "a"), (1, "start", "a"), (2, "start", "b"), (3, "flush", None), (4, "stop", None)])] == [("claimed", "a"), ("undone", "a"), ("claimed", "b"), ("kept", "b")]
    assert [x[1] for x in fold(TempoLock(), [(0, 120.0, 0.7, 30), (1, 121.0, 0.7, 30), (2, 121.0, 0.5, 30), (3, 121.0, 0.3, 30)])] == [False, True, True, False]
    assert [x[1] for x in fold(Recorder(most_s=2), [(0, 10, 8), (1, 10, 8), (2, 4, 9)])] == [10, 6, 0]
    assert fold(Easing(), [(0, 1.0, 0.5), (260, 1.0, 1.0)]) == [(0, 0.5), (260, 1.0)]
    kicks = [x[1] for x in fold(Envelope(), [(t, 1.0 if t % 500 == 0 else 0.0, 0.1, 0.5) for t in range(0, 2000, 20)])]
    assert sum(k > 0.6 for k in kicks) >= 4


def test_tempo_lock_prior():
    rows = [(0, 174.0, 0.9, 30, 138.0), (1, 174.0, 0.9, 30, 138.0), (2, 174.0, 0.9, 30, None), (3, 174.0, 0.9, 30, None), (4, 60.0, 0.1, 30, 300.0)]
    assert [x[1:] for x in fold(PriorTempoLock(), rows)] == [(True, 138.0), (True, 138.0), (True, 138.0), (True, 174.0), (False, None)]


def test_phase_follows_a_drift():
    """Beats of a prior's tempo that is 2 % off: the clock is never more than a twentieth of a beat away from them at a reading."""
    period, real = 60_000 / 120, 60_000 / 120 * 1.02
    off = []
    for t in range(0, 60_000, 1000):
        beat = t // real * real
        off.append((t, None, 0.5, 0, beat, 120.0, None))
    clocks = [x[3] for x in fold(PhaseLock(), off)]
    assert max(abs((c - (r[0] - r[4]) + period / 2) % period - period / 2) for c, r in zip(clocks, off)) < period / 20
    held = fold(PhaseLock(), [(0, 120.0, 0.7, 30, -100.0, None, None), (1000, 120.0, 0.7, 30, 900.0, None, None), (1300, None, 0.5, 0, None, 100.0, None), (1500, None, 0.1, 0, None, 100.0, 55.0), (1600, None, 0.1, 0, None, None, None)])
    assert [x[1:] for x in held] == [(False, None, None), (True, 120.0, 100.0), (True, 100.0, 400.0), (True, 100.0, 55.0), (False, None, None)]


def test_files(spark, tmp_path):
    x = np.linspace(-0.5, 0.5, 100)
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.repeat((x * 32767).astype("<i2"), 2).tobytes())
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    got = {os.path.basename(r["path"]): r for r in sources.read_wav(spark, str(tmp_path / "*.wav")).collect()}
    assert np.allclose(got["a.wav"]["samples"], x, atol=1e-3) and got["a.wav"]["rate"] == 8000 and got["bad.wav"]["error"]
    assert sources.audio_files(spark, str(tmp_path)).count() == 2
    out = tmp_path / "pcm"
    rows = [("/a/s", [0.5, -0.25]), ("/b/s", [1.0])]
    sources.write_pcm(spark.createDataFrame(rows, "path string, samples array<float>"), str(out))
    (out / "odd.pcm").write_bytes(b"abc")
    back = {os.path.basename(r["path"]): r for r in sources.read_pcm(spark, str(out / "*.pcm")).collect()}
    name = lambda k: hashlib.sha256(k.encode()).hexdigest() + ".pcm"
    assert len(back) == 3 and all(back[name(k)]["samples"] == x for k, x in rows) and back["odd.pcm"]["error"]


def test_folders(spark, tmp_path):
    deep = tmp_path / "lib" / "/".join("d" * 13)
    deep.mkdir(parents=True)
    for place in (tmp_path / "lib", deep.parent, deep):
        (place / "x.MP3").write_bytes(b"abc")
    (tmp_path / "lib" / "a.ogg").write_bytes(b"a")
    (tmp_path / "lib" / "no.txt").write_bytes(b"")
    whole = sources.audio_files(spark, str(tmp_path / "lib")).collect()
    names = sorted(r["path"].split("/lib/")[1] for r in whole)
    assert names == sorted(["a.ogg", "x.MP3", "d/" * 12 + "x.MP3"])  # 12 folders down, not 13
    assert all(r["modified_ms"] > 0 and not r["analyzed"] and not r["lyrics_synced"] for r in whole)
    assert [os.path.basename(r["path"]) for r in sources.listed_files(spark, str(tmp_path / "lib")).collect()] == ["a.ogg", "x.MP3"]


def test_tables_hold_a_state_and_no_group(spark):
    """Keys that are null, that span Arrow batches, and samples that come unsorted."""
    rows = [(k, t, "abc"[t // 7 % 3]) for t in range(50) for k in ("x", None, "y")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = over_table(spark.createDataFrame(rows[::-1], "k string, t long, item string"), Changes(), "k").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(k, *m) for k in ("x", None, "y") for m in fold(Changes(), [(t, i) for own, t, i in rows if own == k])]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_texts_and_index(spark, tmp_path):
    (tmp_path / "a.lrc").write_text("[00:01.00]one\n[00:02.00]two")
    (tmp_path / "b.lrc").write_text("nothing")
    assert [r["text"] for r in sources.import_lrc(spark, str(tmp_path / "*.lrc")).orderBy("time_ms").collect()] == ["one", "two"]
    assert sources.read_index(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "i.json").write_text('{"path": "/a", "size": 1, "modified_ms": 2, "analyzed": true, "lyrics_synced": false}\nbroken\n')
    assert [r["path"] for r in sources.read_index(spark, str(tmp_path / "i.json")).collect()] == ["/a"]
    sources.write_documents(spark.createDataFrame([("abc", 1), ("xyz", 2)], "k string, v int"), str(tmp_path / "docs"), "k")
    assert [r["v"] for r in sources.read_documents(spark, str(tmp_path / "docs"), "k", "xyz").collect()] == [2]


def test_frames():
    data = sources.framed(1, b"ab") + sources.framed(2, b"")
    assert list(sources.unframed(data)) == [(1, b"ab"), (2, b"")]
    with pytest.raises(ValueError):
        list(sources.unframed(data[:-1]))
    with pytest.raises(ValueError):
        list(sources.unframed(b"\0\0\0\0"))


def test_journal(spark, tmp_path):
    path = str(tmp_path / "journal")
    assert sources.journal_take(spark, str(tmp_path / "none")).count() == 0
    jobs = spark.createDataFrame([(i, "k", "a", "t", 1000, "/x.pcm", None, 5) for i in "abc"], sources.JOB)
    sources.journal_start(jobs, path)
    sources.journal_finish(jobs.where("id = 'b'"), path)
    first = sources.journal_take(spark, path)
    assert sorted(r["id"] for r in first.collect()) == ["a", "c"] and first.columns == jobs.columns
    sources.journal_start(jobs.limit(1).withColumn("id", F.lit("d")), path)
    assert [r["id"] for r in sources.journal_take(spark, path).collect()] == ["d"]
    assert sources.journal_take(spark, path).count() == 0
    assert sorted(r["id"] for r in first.collect()) == ["a", "c"]  # what was taken stays readable


def test_verified(spark, tmp_path):
    (tmp_path / "ok.bin").write_bytes(b"abc")
    (tmp_path / "bad.bin").write_bytes(b"abd")
    digest = hashlib.sha256(b"abc").hexdigest()
    wanted = [("ok.bin", 3, digest.upper()), ("bad.bin", 3, digest), ("long.bin", 4, digest), ("short.bin", 3, None)]
    (tmp_path / "long.bin").write_bytes(b"abc")
    df = spark.createDataFrame(wanted, "name string, size long, sha256 string")
    got = {r["name"]: r["state"] for r in sources.verified(spark, str(tmp_path), df).collect()}
    assert got == {"ok.bin": "ok", "bad.bin": "wrong digest", "long.bin": "wrong size", "short.bin": "missing"}


def test_rescan(spark, tmp_path):
    from quaverlake.streaming.runner import rescan_on

    spark.createDataFrame([(1,), (2,)], "n int").coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    stream, seen = spark.readStream.schema("n int").option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), {}
    q = rescan_on(stream, lambda batch, number: seen.__setitem__(number, batch.count()), every="1 second", checkpoint=str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
        spark.createDataFrame([(3,)], "n int").coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen == {0: 2, 1: 1}
