"""Files as tables. Contents are read by executors, a file per row; the driver only ever lists."""

from __future__ import annotations

import io
import struct
import time
import uuid
import wave
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import library, lyrics

# The extensions of audio files.
AUDIO = ("mp3", "flac", "wav", "ogg", "m4a", "aac", "opus", "wma")
MAX_DEPTH = 12
INDEX = "path string, size long, modified_ms long, analyzed boolean, lyrics_synced boolean"
JOB = "id string, track_key string, artist string, title string, duration_ms long, pcm_path string, language string, started_at long"
FRAME_LIMIT = 64 << 20


def audio_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, size, modified_ms, analyzed, lyrics_synced) of the audio files in a folder and those below it, not deeper than 12.

    Contents aren't read; both flags are false, and an unknown time is 0. What the file system lists through a symbolic link is listed;
    Spark reads no file of zero bytes, so those are not.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri().getPath()
    place = F.regexp_replace(F.col("path"), "^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    depth = F.size(F.split(place, "/")) - 1 - len([p for p in base.split("/") if p])
    kind = F.lower(F.element_at(F.split("path", r"\."), -1))
    modified = F.coalesce(F.unix_millis("modificationTime"), F.lit(0).cast("long"))
    rows = files.select("path", F.col("length").alias("size"), modified.alias("modified_ms"), F.lit(False).alias("analyzed"), F.lit(False).alias("lyrics_synced"), depth.alias("d"))
    return rows.where(kind.isin(*AUDIO) & (F.col("d") <= MAX_DEPTH + 1)).drop("d")


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """The audio files of one folder without those below it, by path."""
    return audio_files(spark, root, recursive=False).orderBy("path")


def import_lrc(spark: SparkSession, path: str) -> DataFrame:
    """The timed lines of each text file; files without one give no rows."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("lrc"))
    return lyrics.parse_lrc(texts, "path", "lrc")


def read_pcm(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """(path, samples, rate, error) of raw little-endian float files; empty files and odd sizes are errors."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            bad = [None if len(c) and len(c) % 4 == 0 else "empty" if not len(c) else "size isn't a multiple of 4" for c in b["content"]]
            data = [None if e else np.frombuffer(c, "<f4").tolist() for c, e in zip(b["content"], bad)]
            yield pd.DataFrame({"path": b["path"], "samples": data, "rate": rate, "error": bad})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, samples array<float>, rate int, error string")


def pcm_name(key: Column) -> Column:
    """The file name of a key: its digest, so that equal base names stay apart."""
    return F.concat(F.sha2(key.cast("string"), 256), F.lit(".pcm"))


def write_pcm(df: DataFrame, folder: str, key: str = "path", samples: str = "samples") -> None:
    """A raw file per row, named pcm_name(key), in a folder that all executors share.

    Keys must be distinct; a key that repeats leaves the file of one of its rows. A file appears whole or not at all:
    a task writes under a name of its own and renames, so a task that runs again does no harm. Rows without samples
    give empty files.
    """
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getUri().getScheme() != "file":
        raise ValueError("raw files need a folder that is mounted on every executor")
    system.mkdirs(at)
    folder = system.makeQualified(at).toUri().getPath()

    def run(rows) -> None:
        import os

        import numpy as np

        for r in rows:
            name = os.path.join(folder, r["name"])
            part = f"{name}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(np.asarray(r["samples"] if r["samples"] is not None else [], "<f4").tobytes())
            os.replace(part, name)

    df.select(pcm_name(F.col(key)).alias("name"), F.col(samples).alias("samples")).foreachPartition(run)


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, samples, rate, error) of PCM WAV files as the mean of their channels from -1 to 1."""
    def decode(content: bytes):
        import numpy as np

        try:
            with wave.open(io.BytesIO(content)) as w:
                width, raw = w.getsampwidth(), w.readframes(w.getnframes())
                if width == 3:
                    x = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
                    x = ((x[:, 0] << 8 | x[:, 1] << 16 | x[:, 2] << 24) >> 8) / 2.0**23
                else:
                    x = (np.frombuffer(raw, np.uint8) - 128.0) / 128 if width == 1 else np.frombuffer(raw, f"<i{width}") / 2.0 ** (8 * width - 1)
                x = x.reshape(-1, w.getnchannels()).mean(1)
                return (x.astype("float32").tolist(), w.getframerate(), None) if len(x) else (None, None, "empty")
        except (wave.Error, EOFError, ValueError) as e:
            return None, None, str(e) or "unreadable"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [decode(c) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "samples": [o[0] for o in out], "rate": pd.array([o[1] for o in out], "Int32"), "error": [o[2] for o in out]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, samples array<float>, rate int, error string")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An index kept as JSON lines; a missing folder or broken lines give no rows."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], INDEX)
    return spark.read.schema(INDEX).option("mode", "DROPMALFORMED").json(path).where("path is not null")


def _fs(spark: SparkSession, path: str):
    """(Path class, file system) of an address, as Spark reaches it."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind, kind(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list[str]:
    kind, system = _fs(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(kind(path))) if system.exists(kind(path)) else []


def _claimed(spark: SparkSession, address: str) -> bool:
    """Makes a file that must not be there yet: of several callers at once one succeeds."""
    kind, system = _fs(spark, address)
    place = kind(address)
    system.mkdirs(place.getParent())
    if system.getUri().getScheme() == "file":  # Hadoop's own call looks first and creates then
        return spark._jvm.java.io.File(system.makeQualified(place).toUri().getPath()).createNewFile()
    try:
        system.create(place, False).close()
        return True
    except Py4JJavaError as e:
        if any(x in e.java_exception.toString() for x in ("FileAlreadyExists", "AlreadyBeingCreated")):
            return False
        raise


def journal_start(jobs: DataFrame, path: str) -> None:
    """Jobs (as JOB, each with an id of its own) that are about to run, written before they do: a generation of the journal."""
    jobs.select(*[f.split(" ")[0] for f in JOB.split(", ")]).write.parquet(f"{path}/starts/{time.time_ns():020d}-{uuid.uuid4().hex}")


def journal_finish(ids: DataFrame, path: str) -> None:
    """Jobs (id) that ended, by success, failure or cancelling: there is nothing left to resume."""
    ids.select("id").write.mode("append").parquet(f"{path}/finishes")


def journal_take(spark: SparkSession, path: str) -> DataFrame:
    """The jobs that sessions before left unfinished. They are off the journal once this returns, so a job that breaks its session is not tried for ever.

    A generation is claimed by making its claim file, which only one of any callers can: two sessions that start together share
    no job, and none is lost. Meant for the start, before a session's own jobs can be mistaken for old ones. Generations that
    are still being written stay. No journal gives no rows.
    """
    kind, system = _fs(spark, path)
    done = [g for g in _children(spark, f"{path}/starts") if system.exists(kind(f"{path}/starts/{g}/_SUCCESS"))]
    claimed = set(_children(spark, f"{path}/claims"))
    won = [g for g in done if g not in claimed and _claimed(spark, f"{path}/claims/{g}")]
    if not won:
        return spark.createDataFrame([], JOB)
    own = spark.read.schema(JOB).parquet(*[f"{path}/starts/{g}" for g in won])
    taken = f"{path}/taken/{uuid.uuid4().hex}"
    library.unfinished(own, _journal(spark, f"{path}/finishes", "id string")).write.parquet(taken)
    return spark.read.schema(JOB).parquet(taken)


def _journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    kind, system = _fs(spark, path)
    return spark.read.schema(schema).parquet(path) if system.exists(kind(path)) else spark.createDataFrame([], schema)


# --- a cache of documents by key: deltas are only added, the newest row of a key counts

BUCKETS = 256


def _bucket(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def put_documents(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Adds rows, each the newest of its key from now on, as one delta; nothing that is there is read or written again.

    Of rows of one put that share a key, the one that is largest as JSON stays. `key` is a string column. A cache keeps the
    number of buckets that its first put had.
    """
    rows = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.to_json(F.struct(*df.columns))).alias("x")).select("x.*")
    rows = rows.withColumn("bucket", _bucket(key, _buckets(df.sparkSession, path, buckets)))
    rows.write.partitionBy("bucket").parquet(f"{path}/deltas/{time.time_ns():020d}-{uuid.uuid4().hex}")


def _buckets(spark: SparkSession, path: str, buckets: int) -> int:
    names = [n for n in _children(spark, path) if n.startswith("buckets-")]
    if not names:
        _claimed(spark, f"{path}/buckets-{buckets}")
        names = [n for n in _children(spark, path) if n.startswith("buckets-")]
    return int(min(names).split("-")[1])


def _parts(spark: SparkSession, path: str) -> list[str]:
    """The newest whole base and the deltas that it doesn't hold, oldest first. A base is named after the last delta in it."""
    kind, system = _fs(spark, path)
    whole = lambda place: [n for n in _children(spark, f"{path}/{place}") if system.exists(kind(f"{path}/{place}/{n}/_SUCCESS"))]
    base = whole("bases")[-1:]
    return [f"bases/{n}" for n in base] + [f"deltas/{n}" for n in whole("deltas") if not base or n > base[0]]


def all_documents(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The newest row of each key, with its bucket; None if nothing was put."""
    parts = [spark.read.parquet(f"{path}/{p}").withColumn("part_no", F.lit(k)) for k, p in enumerate(_parts(spark, path))]
    if not parts:
        return None
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    own = [c for c in rows.columns if c not in ("part_no", "bucket")]
    return rows.groupBy("bucket", key).agg(F.max_by(F.struct(*own), "part_no").alias("x")).select("bucket", "x.*")


def get_document(spark: SparkSession, path: str, key: str, wanted: str) -> DataFrame | None:
    """The newest row of a key: only its bucket's files are read."""
    rows = all_documents(spark, path, key)
    if rows is None:
        return None
    n = _buckets(spark, path, BUCKETS)
    return rows.where((F.col("bucket") == _bucket(F.lit(wanted), n)) & (F.col(key) == wanted)).drop("bucket")


def compact_documents(spark: SparkSession, path: str, key: str) -> None:
    """Makes one base of the base and all deltas, which then go; answers stay as they are. Meant for one caller at a time."""
    parts = _parts(spark, path)
    if not parts or parts[-1].startswith("bases/"):
        return
    name = parts[-1].split("/")[1]
    all_documents(spark, path, key).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/bases/{name}")
    kind, system = _fs(spark, path)
    for p in parts:
        system.delete(kind(f"{path}/{p}"), True)


def write_documents(df: DataFrame, path: str, key: str) -> None:
    """Documents by the first two digits of their key, so that one is found without a full scan. Replaces what is there."""
    df.withColumn("prefix", F.substring(key, 1, 2)).repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(path)


def read_documents(spark: SparkSession, path: str, key: str, wanted: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("prefix") == wanted[:2]) & (F.col(key) == wanted)).drop("prefix")


def verified(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """expected (name, size, sha256) plus what is there: `missing`, `wrong size`, `wrong digest` or `ok`."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("__n"), F.sha2("content", 256).alias("__d"))
    state = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") != F.col("size"), "wrong size").when(F.col("__d") != F.lower("sha256"), "wrong digest").otherwise("ok")
    return expected.join(files, "name", "left").withColumn("state", state).drop("__n", "__d")


def framed(kind: int, payload: bytes) -> bytes:
    """Length (little-endian, of kind and payload), kind, payload."""
    if len(payload) + 1 > FRAME_LIMIT:
        raise ValueError("frame too long")
    return struct.pack("<IB", len(payload) + 1, kind) + payload


def unframed(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError("cut frame")
        (n,) = struct.unpack_from("<I", data, at)
        if not 0 < n <= FRAME_LIMIT or at + 4 + n > len(data):
            raise ValueError("bad frame length")
        yield data[at + 4], data[at + 5 : at + 4 + n]
        at += 4 + n
