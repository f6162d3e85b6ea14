"""Near duplicates by MinHash: universal hash minima, banding, verification by signatures and then by whole sets.

A document's set is that of its 5-word shingles; two link if 100 * |A and B| >= 85 * |A or B|.

1. each text gives HASHES minima of multiply-add hashes over its shingles (16 bits of each are kept) and a digest of
   its set; equal sets are one node, so copies cost nothing from here on;
2. BANDS bands of the signature are buckets; two sets of similarity 0.85 share none with probability 3e-7;
3. first links: each node of a bucket is held against the bucket's smallest node; the pair of the best signatures, one
   for each node, is confirmed on both whole texts. Their components (large-star, small-star) settle most buckets;
4. buckets that still hold several components are searched for pairs across these: a pair whose signatures agree in
   LEAST_EQUAL places or more (5 deviations under 0.85) is confirmed on the whole sets in the first bucket that both
   share. No pair becomes a row: only the nodes that have such a pair travel with their texts, once a bucket, and a
   task returns a spanning forest of the links it finds. Buckets of more than `tile` nodes are cut into tiles;
5. components of all links give the smallest document that each one reaches.

No candidate is capped or left out. What stays quadratic is the comparison of signatures inside a bucket whose sets
are alike but not linked (44 ns a pair).

Defined cases: null and blank texts have an empty set and link with nothing; a text of under five words has one
shingle, all its words; rows that share a doc_id are told apart by their sets; a null doc_id links like any other but
names no component, is never kept and has a null component if all of it has; repeated rows are in one component and
each carry the flag of their doc_id; extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialize, null_safe_text, read_table

SHINGLE = 5
#: Link if 100 * intersection >= PERCENT * union.
PERCENT = 85
BANDS = 32
ROWS = 6
HASHES = BANDS * ROWS
#: Of HASHES = 192 places; the deviation at 0.85 is 5 places.
LEAST_EQUAL = 138
#: Nodes of a bucket that are met in one group, and shingles or signature places that are looked at together.
TILE = 1024
CHUNK = 1 << 18

_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


# --- sets and signatures

def shingles(text: bytes) -> np.ndarray:
    """The sorted XXH64 of a text's distinct shingles: ASCII lower case, words between ASCII white space."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(w[k:] for k in range(SHINGLE)))) if len(w) >= SHINGLE else [b" ".join(w)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, max(1, len(w) - SHINGLE + 1)))


def signature(h: np.ndarray) -> bytes:
    """Minima of a * h + b over the set for HASHES pairs (a, b), bits 32 to 47 of each."""
    least = np.full(HASHES, ~np.uint64(0))
    step = CHUNK // HASHES
    for k in range(0, len(h), step):
        x = np.multiply.outer(_A, h[k : k + step])
        x += _B[:, None]
        np.minimum(least, x.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint16).tobytes()


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digest, sig = [], [], []
        for t in batch.column(2).cast(pa.binary()):
            h = shingles(t.as_buffer().to_pybytes())
            n.append(len(h))
            digest.append(xxhash.xxh3_128_digest(h.tobytes()))
            sig.append(signature(h) if len(h) else None)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["key", "mark", "n", "digest", "sig"])


def prints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, mark, n, digest, sig) of every row; mark is a hash of the text that Spark can compute again."""
    own = df.select(F.col(key).cast("long").alias("key"), F.xxhash64(null_safe_text(text)).alias("mark"), null_safe_text(text).alias("body"))
    return own.mapInArrow(_prints, "key long, mark long, n long, digest binary, sig binary")


def nodes_of(marked: DataFrame) -> DataFrame:
    """(node, digest, sig, key, mark) of every distinct set that isn't empty; key and mark name a row that has it."""
    who = F.struct(F.col("key").isNull().alias("no"), "key", "mark")
    out = marked.where("n > 0").groupBy("digest").agg(F.max("sig").alias("sig"), F.min(who).alias("who"))
    return out.select(F.monotonically_increasing_id().alias("node"), "digest", "sig", "who.key", "who.mark")  # ids hold once they are written


def texts_of(wanted: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """(node, body): one whole text of each wanted node (node, key, mark)."""
    rows = df.select(F.col(key).cast("long").alias("k"), F.xxhash64(null_safe_text(text)).alias("m"), null_safe_text(text).alias("body"))
    met = rows.join(wanted, F.col("k").eqNullSafe(F.col("key")) & (F.col("m") == F.col("mark")))
    return met.groupBy("node").agg(F.max("body").alias("body"))  # repeated rows have one text


def linked(inter: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    return 100 * inter >= PERCENT * (a + b - inter)


# --- buckets and first links

def buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, band, node, least) of all buckets with more than one node."""
    band = lambda k: F.struct(F.lit(k).alias("band"), F.xxhash64(F.lit(k), F.substring("sig", 2 * ROWS * k + 1, 2 * ROWS)).alias("bucket"))
    rows = nodes.select("node", F.explode(F.array(*map(band, range(BANDS)))).alias("x")).select("node", "x.*")
    shared = rows.groupBy("bucket", "band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    return rows.join(shared, ["bucket", "band"]).select("bucket", "band", "node", "least")


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sigs = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, HASHES) for k in (2, 3)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array((sigs[0] == sigs[1]).sum(1).astype(np.int32))], ["a", "b", "equal"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))
    for batch in batches:
        ok = []
        for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())):
            if a != last[0]:
                last = a, shingles(x.as_buffer().to_pybytes())
            other = shingles(y.as_buffer().to_pybytes())
            ok.append(linked(len(np.intersect1d(last[1], other, assume_unique=True)), len(last[1]), len(other)))
        yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def first_links(shared: DataFrame, nodes: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b): for each node b the smallest node of a bucket that is most like it, if both sets link."""
    stars = shared.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    sigs = nodes.select("node", "sig")
    pairs = stars.join(sigs.toDF("a", "x"), "a").join(sigs.toDF("b", "y"), "b").select("a", "b", "x", "y")
    pairs = pairs.mapInArrow(_agreement, "a long, b long, equal int").where(F.col("equal") >= LEAST_EQUAL)
    best = materialize(pairs.groupBy("b").agg(F.max_by("a", F.struct("equal", "a")).alias("a")), "minhash-stars")
    wanted = nodes.join(best.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node").select("node", "key", "mark")
    body = materialize(texts_of(wanted, df, key, text), "minhash-texts")
    met = best.join(body.toDF("b", "y"), "b").join(body.toDF("a", "x"), "a").select("a", "b", "x", "y")
    return met.mapInArrow(_confirmed, "a long, b long")


# --- buckets that hold several components

class Cell:
    """Nodes that meet in one bucket, or in two tiles of one."""

    def __init__(self, t: pa.Table):
        column = lambda n: t[n].to_numpy()
        self.node, self.label, self.tile, self.band = column("node"), column("label").copy(), column("tile"), int(t["band"][0].as_py())
        self.sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(-1, HASHES)
        self.cross = t["low"][0].as_py() != t["high"][0].as_py()

    def near(self, i: int) -> np.ndarray:
        """Later nodes of other components that this bucket is the first to share with node i, and whose signatures are near."""
        j = np.arange(i + 1, len(self.node))
        j = j[self.label[j] != self.label[i]]
        if self.cross:
            j = j[self.tile[j] != self.tile[i]]
        found = []
        for k in range(0, len(j), CHUNK // HASHES):
            own = j[k : k + CHUNK // HASHES]
            same = self.sig[own] == self.sig[i]
            good = same.sum(1) >= LEAST_EQUAL
            own, same = own[good], same[good]
            found.append(own[~same.reshape(-1, BANDS, ROWS).all(2)[:, : self.band].any(1)])
        return np.concatenate(found) if found else j


def _with_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a cell that have a pair to confirm there, without signatures."""
    t = pa.Table.from_batches(batches)
    cell, use = Cell(t), np.zeros(t.num_rows, bool)
    for i in range(t.num_rows):
        j = cell.near(i)
        use[j] = True
        use[i] |= len(j) > 0
    if use.any():
        yield from t.drop_columns(["sig"]).filter(pa.array(use)).combine_chunks().to_batches()


def _links_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest (a, b) of the links between the components of a cell."""
    t = pa.Table.from_batches(batches)
    cell, out = Cell(t), []
    sets = [shingles(x.as_buffer().to_pybytes()) for x in t["body"].combine_chunks().cast(pa.binary())]
    size = np.array([len(s) for s in sets])
    for i in range(t.num_rows):
        j = cell.near(i)
        j = j[linked(np.minimum(size[j], size[i]), size[j], size[i])]
        if not len(j):
            continue
        step = max(1, CHUNK // int(size[j].max()))
        for c in range(0, len(j), step):
            own = j[c : c + step]
            rest = np.concatenate([sets[k] for k in own])
            met = sets[i][np.minimum(np.searchsorted(sets[i], rest), size[i] - 1)] == rest
            inter = np.add.reduceat(met, np.cumsum(size[own]) - size[own], dtype=np.int64)
            for k in own[linked(inter, size[own], size[i])]:
                if cell.label[k] != cell.label[i]:
                    cell.label[cell.label == cell.label[k]] = cell.label[i]
                    out.append((cell.node[i], cell.node[k]))
    if out:
        yield pa.record_batch([pa.array([int(x[k]) for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])


_CELL = ["bucket", "band", "low", "high"]
_ROWS = "bucket long, band int, low int, high int, node long, label long, tile int"


def last_links(shared: DataFrame, nodes: DataFrame, labels: DataFrame, df: DataFrame, key: str, text: str, tile: int = TILE) -> DataFrame:
    """(a, b): links between components (node, component) that buckets hold several of."""
    own = shared.join(labels, "node", "left").select("bucket", "band", "node", F.coalesce("component", "node").alias("label"))
    several = own.groupBy("bucket", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    own = own.join(several, ["bucket", "band"]).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    own = own.withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    own = own.select("bucket", "band", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "node", "label", "tile")
    sigs = nodes.select("node", "sig")
    cells = own.join(sigs, "node").groupBy(*_CELL)
    needed = materialize(cells.applyInArrow(_with_pairs, _ROWS), "minhash-pairs")
    wanted = nodes.join(needed.select("node").distinct(), "node").select("node", "key", "mark")
    body = texts_of(wanted, df, key, text)
    return needed.join(sigs, "node").join(body, "node").groupBy(*_CELL).applyInArrow(_links_of, "a long, b long")


# --- components

def group(df: DataFrame, key: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    marked = materialize(prints(df, key, text), "minhash-prints")
    nodes = materialize(nodes_of(marked), "minhash-nodes")
    shared = materialize(buckets(nodes), "minhash-buckets")
    links = materialize(first_links(shared, nodes, df, key, text), "minhash-links")
    more = last_links(shared, nodes, connected_components(links), df, key, text, tile)
    roots = connected_components(links.unionByName(materialize(more, "minhash-links")))
    rooted = nodes.join(roots, "node", "left").select("digest", "key", F.coalesce("component", "node").alias("root"))
    names = rooted.groupBy("root").agg(F.min("key").alias("component_id"))
    named = rooted.join(names, "root").select("digest", "component_id")
    out = marked.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(named, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(read_table(spark, sf_dir, "documents"))


SQL = None
