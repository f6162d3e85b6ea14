"""Formats for spark.read, write and readStream: raw samples in chunks, frames, and a watched folder.

Files are reached by their address through pyarrow's file systems (file, hdfs, s3, gs), so no folder needs to be mounted.
The driver lists; contents are read by tasks, each a range of a file.

`samples`      reads raw little-endian floats as (path, chunk_no, sr, samples, error): a task reads the chunks of one range.
               Options: path, rate (16000), chunk (samples of one, 65536), split (bytes of a range, 64 MB).
               An empty file, or one of a size that isn't a multiple of 4, is a row with an error.
               writes (key, samples): a file per row, named by the key's digest; they appear once all tasks are done.
`frames`       reads (path, at, kind, payload, error) of files of frames [u32 length][u8 kind][payload]. Ranges begin
               where frames do. A broken frame ends its file with an error. Filters on kind are taken: payloads of others
               are passed over, not read. Options: path, split.
`folder_changes` streams (path, size, modified_ms, change) of the audio files of a folder and those below it: what two
               listings differ in. Options: path, state (a folder for listings), depth (12). An offset is the number of a
               listing kept in `state`, so that a query that starts again goes on from the one it had done.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from .files import AUDIO, FRAME_LIMIT, MAX_DEPTH

CHUNK, SPLIT = 1 << 16, 64 << 20


def opened(address: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(address if "://" in address or address.startswith("/") else f"/{address}")


def listing(address: str, depth: int = 64) -> list[pafs.FileInfo]:
    """The files of a folder and those below it, or the file itself, by path; names that begin with . or _ are left out."""
    system, path = opened(address)
    info = system.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [info]
    root = path.rstrip("/").count("/")
    found = system.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    names = [x for x in found if x.type == pafs.FileType.File and x.base_name[:1] not in "._" and x.path.count("/") - root - 1 <= depth]
    return sorted(names, key=lambda x: x.path)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int


def _options(options: dict, name: str, default: int) -> int:
    n = int(options.get(name, default))
    if n <= 0:
        raise ValueError(f"{name} must be positive")
    return n


# --- samples

class SamplesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.at, self.rate = options["path"], _options(options, "rate", 16_000)
        self.chunk = _options(options, "chunk", CHUNK)
        self.step = max(1, _options(options, "split", SPLIT) // (4 * self.chunk)) * 4 * self.chunk

    def partitions(self) -> list[Range]:
        out = []
        for f in listing(self.at):
            whole = f.size if f.size % 4 == 0 else 0
            out += [Range(f.path, k, min(k + self.step, f.size), f.size) for k in range(0, max(whole, 1), self.step)]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        import numpy as np

        if part.size == 0 or part.size % 4:
            yield part.path, 0, self.rate, None, "size isn't a multiple of 4" if part.size else "empty"
            return
        with opened(self.at)[0].open_input_file(part.path) as f:
            for at in range(part.start, part.end, 4 * self.chunk):
                f.seek(at)
                raw = f.read(min(4 * self.chunk, part.end - at))
                yield part.path, at // (4 * self.chunk), self.rate, np.frombuffer(raw, "<f4").tolist(), None


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class SamplesWriter(DataSourceWriter):
    """Tasks write into a folder of the job's own; the driver moves their files at the end, or deletes that folder."""

    def __init__(self, options: dict, overwrite: bool):
        self.at, self.overwrite = options["path"].rstrip("/"), overwrite
        self.key, self.samples = options.get("key", "key"), options.get("samples", "samples")
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, rows) -> Written:
        import hashlib

        import numpy as np

        system, path = opened(self.at)
        own, done = f"{path}/{self.job}/{uuid.uuid4().hex}", []
        system.create_dir(own, recursive=True)
        for r in rows:
            name = f"{hashlib.sha256(str(r[self.key]).encode()).hexdigest()}.pcm"
            with system.open_output_stream(f"{own}/{name}") as f:
                f.write(np.asarray(r[self.samples] if r[self.samples] is not None else [], "<f4").tobytes())
            done.append((f"{own}/{name}", name))
        return Written(done)

    def commit(self, messages: list) -> None:
        system, path = opened(self.at)
        if self.overwrite:
            for f in listing(self.at, 0):
                system.delete_file(f.path)
        for m in messages:
            for held, name in m.files if m else []:
                system.move(held, f"{path}/{name}")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        system, path = opened(self.at)
        if system.get_file_info(f"{path}/{self.job}").type == pafs.FileType.Directory:
            system.delete_dir(f"{path}/{self.job}")


class Samples(DataSource):
    @classmethod
    def name(cls) -> str:
        return "samples"

    def schema(self) -> str:
        return "path string, chunk_no long, sr int, samples array<float>, error string"

    def reader(self, schema) -> SamplesReader:
        return SamplesReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> SamplesWriter:
        return SamplesWriter(dict(self.options), overwrite)


# --- frames

class FramesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.at, self.split, self.kinds = options["path"], _options(options, "split", SPLIT), None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("kind",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.kinds = own if self.kinds is None else self.kinds & own
            yield f  # errors have no kind: Spark drops them and whatever else is over

    def partitions(self) -> list[Range]:
        """Cut where a frame begins, `split` bytes or more after the last cut: lengths are hopped along, payloads aren't read."""
        out = []
        for f in listing(self.at):
            start = at = 0
            if f.size > self.split:
                with opened(self.at)[0].open_input_file(f.path) as data:
                    while at < f.size:
                        n = self._length(data, at, f.size)
                        if n is None:
                            break
                        at += 4 + n
                        if at - start >= self.split and at < f.size:
                            out.append(Range(f.path, start, at, f.size))
                            start = at
            out.append(Range(f.path, start, f.size, f.size))
        return out

    @staticmethod
    def _length(data, at: int, size: int) -> int | None:
        data.seek(at)
        raw = data.read(4)
        n = struct.unpack("<I", raw)[0] if len(raw) == 4 else 0
        return n if 0 < n <= FRAME_LIMIT and at + 4 + n <= size else None

    def read(self, part: Range) -> Iterator[tuple]:
        with opened(self.at)[0].open_input_file(part.path) as data:
            at = part.start
            while at < part.end:
                n = self._length(data, at, part.size)
                if n is None:
                    if self.kinds is None:
                        yield part.path, at, None, None, "cut frame" if at + 4 > part.size else "bad frame length"
                    return
                kind = data.read(1)[0]
                if self.kinds is None or kind in self.kinds:
                    yield part.path, at, kind, data.read(n - 1), None
                at += 4 + n


class Frames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "path string, at long, kind int, payload binary, error string"

    def reader(self, schema) -> FramesReader:
        return FramesReader(dict(self.options))


# --- a watched folder

@dataclass
class Part(InputPartition):
    before: int
    after: int
    number: int


class FolderReader(DataSourceStreamReader):
    PARTS = 8
    _LISTING = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified_ms", pa.int64())])

    def __init__(self, options: dict):
        self.at, self.state, self.depth = options["path"], options["state"].rstrip("/"), int(options.get("depth", MAX_DEPTH))

    def _kept(self) -> dict[int, str]:
        return {int(f.base_name.split("-")[1].split(".")[0]): f.path for f in listing(self.state, 0) if f.base_name.startswith("listing-")}

    def _load(self, n: int) -> dict[str, tuple[int, int]]:
        if n == 0:
            return {}
        import pyarrow.parquet as pq

        system, path = opened(self.state)
        t = pq.read_table(f"{path}/listing-{n:09d}.parquet", filesystem=system).to_pydict()
        return dict(zip(t["path"], zip(t["size"], t["modified_ms"])))

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        """The number of the last listing; of a new one if the folder isn't as that says."""
        import pyarrow.parquet as pq

        last = max(self._kept(), default=0)
        now = [f for f in listing(self.at, self.depth) if f.extension.lower() in AUDIO]
        rows = {f.path: (f.size, (f.mtime_ns or 0) // 1_000_000) for f in now}
        if rows != self._load(last):
            system, path = opened(self.state)
            system.create_dir(path, recursive=True)
            t = pa.table([list(rows), [x[0] for x in rows.values()], [x[1] for x in rows.values()]], schema=self._LISTING)
            last += 1
            part = f"{path}/_{uuid.uuid4().hex}"
            pq.write_table(t, part, filesystem=system)
            system.move(part, f"{path}/listing-{last:09d}.parquet")
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(start["listing"], end["listing"], k) for k in range(self.PARTS)]

    def read(self, part: Part) -> Iterator[tuple]:
        import zlib

        own = lambda rows: {p: x for p, x in rows.items() if zlib.crc32(p.encode()) % self.PARTS == part.number}
        before, after = own(self._load(part.before)), own(self._load(part.after))
        for p, x in after.items():
            if before.get(p) != x:
                yield p, *x, "changed" if p in before else "added"
        for p, x in before.items():
            if p not in after:
                yield p, *x, "removed"

    def commit(self, end: dict) -> None:
        """Listings before the one that is done aren't asked for again."""
        system, _ = opened(self.state)
        for n, path in self._kept().items():
            if n < end["listing"]:
                system.delete_file(path)


class FolderChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return "path string, size long, modified_ms long, change string"

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))


# --- for Spark

def register(spark: SparkSession) -> None:
    """Makes the three formats known to a session, and lets it hand filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    for source in (Samples, Frames, FolderChanges):
        spark.dataSource.register(source)


def read_chunks(spark: SparkSession, path: str, rate: int = 16_000, chunk: int = CHUNK, split: int = SPLIT) -> DataFrame:
    """(path, chunk_no, sr, samples, error) of raw files: see `samples`."""
    register(spark)
    return spark.read.format("samples").options(path=path, rate=rate, chunk=chunk, split=split).load()


def write_samples(df: DataFrame, path: str, key: str = "key", samples: str = "samples", overwrite: bool = False) -> None:
    """A raw file per row: see `samples`. Keys must be distinct; of one that repeats, the file of one row stays."""
    register(df.sparkSession)
    rows = df.select(key, samples)
    rows.write.format("samples").options(key=key, samples=samples, path=path).mode("overwrite" if overwrite else "append").save()


def read_frames(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(path, at, kind, payload, error) of files of frames: see `frames`."""
    register(spark)
    return spark.read.format("frames").options(path=path, split=split).load()


def folder_changes(spark: SparkSession, path: str, state: str, depth: int = MAX_DEPTH) -> DataFrame:
    """The stream of what is added, changed and removed in a folder: see `folder_changes`."""
    register(spark)
    return spark.readStream.format("folder_changes").options(path=path, state=state, depth=depth).load()
