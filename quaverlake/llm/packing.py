"""Token ids packed into fixed-length rows by best-fit decreasing.

Each text becomes token ids and an end mark. Documents longer than a row are split
losslessly: full rows first, the rest is packed with the others. Within a window of
`window_tokens`, pieces are taken by falling length and put into the fullest row that still
holds them; a segment tree over free capacities finds that row in log(length) steps.

A packed row holds `input_ids` (little-endian uint16 or uint32, padded to the row length),
`cu_seqlens` (cumulative segment lengths from 0), `position_resets` (where positions start
again at 0), and per segment the document and the offset in it, so that texts can be put
together again. Texts are dealt into windows by a hash of key and text, and are sorted in
them, so packed rows don't depend on how the table lies in files, and a lost task packs the
same rows again. The number of windows follows the bytes of all texts. Many equal rows (key
and text) share a window, which is then packed in parts of `window_tokens`.

Without an encoder ids are UTF-8 bytes, the end mark is 256 and padding 257. An encoder
takes a list of UTF-8 texts and returns an integer array for each; `byte_pairs` makes one of
a file of ranks, and the query packs its ids.

Defined cases: null and empty texts give a segment that is only the end mark, null keys stay
null, repeated rows are packed each, an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import read_table

ROW = 2048
#: Bytes of text, and end marks, of a window: no text has more ids than bytes.
WINDOW_TOKENS = 8 << 20
END, PAD = 256, 257
#: A file of byte-level BPE ranks (public, not in the repository), and its first free ids.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
RANKS_END, RANKS_PAD = 50_256, 50_257
# Fixed value: how these ranks' texts are cut before pairs are merged.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

HEADER = "dtype string, length int, end int, pad int"
SCHEMA = "pack_id string, n_tokens int, doc_ids array<long>, offsets array<long>, cu_seqlens array<int>, position_resets array<int>, input_ids binary"


class Capacities:
    """Rows by free capacity 0..n; a segment tree tells the smallest capacity of at least x that some row has."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.any = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(n + 1)]

    def _mark(self, c: int, step: int) -> None:
        node = c + self.size
        while node:
            self.any[node] += step
            node >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._mark(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(row, capacity) of the fullest row with room for `least`, removed; None if there is none."""
        node = least + self.size
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        c = node - self.size
        row = self.rows[c].pop()
        self._mark(c, -1)
        return row, c


def best_fit_decreasing(lengths: list[int], n: int = ROW) -> list[list[int]]:
    """Indexes of the pieces (each at most n long) by row."""
    free, rows = Capacities(n), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if (at := free.take(lengths[i])) is None:
            rows.append([i])
            row, left = len(rows) - 1, n - lengths[i]
        else:
            row, left = at[0], at[1] - lengths[i]
            rows[row].append(i)
        if left:
            free.put(left, row)
    return rows


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", row: int = ROW, encoder: Callable | None = None, end: int = END, pad: int = PAD, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """Packed rows of SCHEMA. pack_id names window, part of it and row."""
    kind = np.dtype("<u2" if max(end, pad) < 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_window, part, pieces, held = None, 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal pieces, held, part
            packs = best_fit_decreasing([len(p[2]) for p in pieces], row)
            for a in range(0, len(packs), 512):
                out = []
                for k, own in enumerate(packs[a : a + 512], a):
                    ids = np.full(row, pad, kind)
                    cuts = np.concatenate(([0], np.cumsum([len(pieces[i][2]) for i in own])))
                    ids[: cuts[-1]] = np.concatenate([pieces[i][2] for i in own])
                    out.append((f"{own_window:08d}-{part:05d}-{k:06d}", int(cuts[-1]), [pieces[i][0] for i in own], [pieces[i][1] for i in own], cuts.tolist(), cuts[:-1].tolist(), ids.tobytes()))
                kinds = [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [f.split(" ")[0] for f in SCHEMA.split(", ")])
            pieces, held, part = [], 0, part + 1

        for batch in batches:
            keys, texts, windows = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()
            for a in range(0, len(keys), 256):
                bodies = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts.slice(a, 256)]
                coded = [np.frombuffer(b, np.uint8) for b in bodies] if encoder is None else encoder(bodies)
                for k, ids, w in zip(keys[a : a + 256], coded, windows[a : a + 256]):
                    if w != own_window:
                        if pieces:
                            yield from flush()
                        own_window, part = w, 0
                    ids = np.append(ids.astype(kind), kind.type(end))
                    pieces += [(k, s, ids[s : s + row]) for s in range(0, len(ids), row)]
                    held += len(ids)
                    if held >= 2 * window_tokens:  # windows by hash differ in size; only long or repeated texts fill two
                        yield from flush()
        if pieces:
            yield from flush()

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)).first()[0] or 0
    rows = rows.withColumn("window", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(max(1, -(-total // window_tokens)))))
    return rows.repartition("window").sortWithinPartitions("window", "doc_id", "text").mapInArrow(run, SCHEMA)


def byte_pairs(path: str = RANKS, pieces: str = PIECES) -> Callable[[list[bytes]], list[np.ndarray]]:
    """An encoder by the ranks of a file, which every worker reads once. Bytes that aren't UTF-8 are replaced."""

    def encode(texts: list[bytes]) -> list[np.ndarray]:
        coder = _coder(path, pieces)
        return [np.array(coder.encode_ordinary(t.decode("utf-8", "replace")), np.uint32) for t in texts]

    return encode


@lru_cache(maxsize=2)
def _coder(path: str, pieces: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=pieces, mergeable_ranks=ranks, special_tokens={})


def write_packed(packs: DataFrame, path: str, row: int = ROW, end: int = END, pad: int = PAD) -> None:
    """`rows`: Parquet files whose binary column is the id matrix, a row of it each. `header`: one JSON line that says how to read it.

    An existing folder is an error. The header comes last: a folder without one was not finished.
    """
    packs.write.parquet(f"{path}/rows")
    header = [("<u2" if max(end, pad) < 1 << 16 else "<u4", row, end, pad)]
    packs.sparkSession.createDataFrame(header, HEADER).coalesce(1).write.json(f"{path}/header")


def read_packed(spark: SparkSession, path: str) -> tuple[DataFrame, Row]:
    """(packed rows, header) as write_packed left them."""
    return spark.read.parquet(f"{path}/rows"), spark.read.schema(HEADER).json(f"{path}/header").first()


def unpack(row, dtype: str = "<u2", length: int = ROW) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """(position ids, segments as (doc_id, offset, ids)) of a packed row."""
    ids = np.frombuffer(row["input_ids"], dtype)
    assert len(ids) == length
    cuts = row["cu_seqlens"]
    positions = np.concatenate([np.arange(b - a) for a, b in zip(cuts, cuts[1:])])
    return positions, [(d, o, ids[a:b]) for d, o, a, b in zip(row["doc_ids"], row["offsets"], cuts, cuts[1:])]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), encoder=byte_pairs(), end=RANKS_END, pad=RANKS_PAD)


SQL = None
