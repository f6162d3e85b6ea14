"""Nearest neighbours by few stable projections in kd-trees (after Sun et al. 2014).

Largest inner products become smallest distances: with M the largest norm, each vector x
gets the coordinate sqrt(M^2 - |x|^2) and each query a 0. All vectors are projected on
`dims` Gaussian directions. A kd-tree over the projections, whose upper splits come from
a sample of `SAMPLE` rows or `LEAF_SAMPLE` a leaf if that is more, deals all rows into leaves of
about `leaf_rows`; each leaf is searched through a kd-tree of its own. The driver holds the
sample's projections, and a box a leaf.

A query looks at buckets by growing projected distance, verifies their vectors exactly, and
stops when the next bucket's squared projected distance exceeds d_k^2 times the chi-square
quantile of `dims` degrees: a nearer neighbour that far out has a chance below 1 - p. Its
own leaf comes first; the leaves that its d_k does not rule out come second.

Of equal vectors only the k + 1 smallest ids can be among k nearest and not the query, so
only these are indexed: results stay whole and no leaf holds a large group of copies. Leaves
that many queries visit are dealt to several tasks.

Defined cases: vectors that are null, zero or hold a null or non-finite component take no part;
vectors of different lengths are no neighbours, so each length is searched on its own; repeated
(id, vector) rows count once; an id with several vectors is as many candidates, and its queries are
answered together (the k best of all their pairs); ties go to the smaller id; fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, read_table

K = 20
DIMS = 8
P = 0.95
LEAF_ROWS = 8192
SAMPLE = 16384
LEAF_SAMPLE = 32
#: Query-leaf distances that are computed at once.
ROUTED = 1 << 22
BUCKET = 64
#: Queries of a leaf that one task takes.
CHUNK = 4096
SEED = 7
SCHEMA = "query_id long, rank int, vec_id long, score double"


def chi_square_quantile(p: float, k: int) -> float:
    """By bisection on the series of the incomplete gamma function."""
    from math import exp, lgamma, log

    def cdf(x: float) -> float:
        a, y = k / 2, x / 2
        term = total = exp(a * log(y) - y - lgamma(a + 1)) if y > 0 else 0.0
        for n in range(1, 2000):
            term *= y / (a + n)
            total += term
            if term < 1e-16 * total:
                break
        return total

    lo, hi = 0.0, k + 20 * (k**0.5) * max(1.0, NormalDist().inv_cdf(p))
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def splits(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and values of a complete kd-tree's inner nodes, in heap order."""
    dims, values = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
    parts = {0: sample}
    for node in range(2**depth - 1):
        x = parts.pop(node)
        if len(x) > 1:
            dims[node] = int(np.argmax(np.ptp(x, axis=0)))
            values[node] = np.median(x[:, dims[node]])
        left = x[:, dims[node]] < values[node] if len(x) else np.zeros(0, bool)
        parts[2 * node + 1], parts[2 * node + 2] = x[left], x[~left]
    return dims, values


def leaf_of(x: np.ndarray, dims: np.ndarray, values: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for _ in range((len(dims) + 1).bit_length() - 1):
        node = 2 * node + 1 + (x[np.arange(len(x)), dims[node]] >= values[node])
    return node - len(dims)


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points (n, d) from boxes (b, d): (n, b)."""
    out = np.zeros((len(q), len(low)))
    for k in range(q.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, k] - q[:, k, None], q[:, k, None] - high[None, :, k]), 0)
        out += gap * gap
    return out


class Leaf:
    """The vectors of a leaf in buckets of a kd-tree over their projections."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, proj: np.ndarray, bucket: int = BUCKET):
        order, todo, cuts = [], [np.arange(len(ids))], [0]
        while todo:
            own = todo.pop()
            if len(own) <= bucket:
                order.append(own)
                cuts.append(cuts[-1] + len(own))
                continue
            d = int(np.argmax(np.ptp(proj[own], axis=0)))
            half = np.argpartition(proj[own, d], len(own) // 2)
            todo += [own[half[len(own) // 2 :]], own[half[: len(own) // 2]]]
        at = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.ids, self.x, self.cuts = ids[at], x[at], np.array(cuts)
        p = proj[at]
        self.low = np.minimum.reduceat(p, self.cuts[:-1]) if len(p) else p
        self.high = np.maximum.reduceat(p, self.cuts[:-1]) if len(p) else p

    def search(self, qid: int, q: np.ndarray, near: np.ndarray, k: int, bound: float, norm: float, chi: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the k nearest; near: squared projected distances of the buckets, bound: d_k^2 so far."""
        order = np.argsort(near, kind="stable")
        ids, scores, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 4
        while at < len(order) and near[order[at]] <= bound * chi:
            take = order[at : at + step]
            take = take[near[take] <= bound * chi]
            rows = np.concatenate([np.arange(self.cuts[b], self.cuts[b + 1]) for b in take])
            rows = rows[self.ids[rows] != qid]
            ids, scores = np.concatenate((ids, self.ids[rows])), np.concatenate((scores, np.einsum('ij,j->i', self.x[rows], q)))
            if len(ids) > k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            if len(ids) == k:
                bound = min(bound, norm - 2 * scores.min())
            at += len(take)
            step = min(2 * step, 64)
        return ids, scores


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, x) of the rows that take part, x as doubles."""
    x = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("id"), x.alias("x")).where("id is not null and x is not null")
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("x", lambda v: v != 0)
    return rows.where(F.coalesce(fine, F.lit(False)))


def search(df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = K, dims: int = DIMS, p: float = P, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Per query row (is_query, a Column over `id`): query_id, rank, vec_id, score of its k nearest other rows."""
    rows = valid_vectors(df, key, vector)
    lengths = sorted(r[0] for r in rows.select(F.size("x")).distinct().collect())  # a row per length
    found = [search_length(rows.where(F.size("x") == n), is_query, k, dims, p, leaf_rows) for n in lengths]
    if not found:
        return df.sparkSession.createDataFrame([], SCHEMA)
    if len(found) == 1:
        return found[0]
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # an id may have vectors of two lengths
    both = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best))
    return both.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_length(rows: DataFrame, is_query, k: int, dims: int, p: float, leaf_rows: int) -> DataFrame:
    """search() over rows (id, x) whose vectors have one length."""
    spark = rows.sparkSession
    queries = rows.where(is_query).distinct()
    same = Window.partitionBy("x").orderBy("id")
    rows = rows.distinct().withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("id", "x")
    rows = materialize(rows, "ann-rows")
    head = rows.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)), F.count("*"), F.max(F.size("x"))).first()
    if not head[1]:
        return spark.createDataFrame([], SCHEMA)
    top, count, width = float(head[0]), int(head[1]), int(head[2])
    depth = max(0, int(np.ceil(np.log2(max(1, count / leaf_rows)))))
    directions = np.random.default_rng(SEED).standard_normal((width + 1, dims))
    chi = chi_square_quantile(p, dims)

    def project(x: np.ndarray, data: bool) -> np.ndarray:
        more = np.sqrt(np.maximum(top - (x * x).sum(1), 0)) if data else np.zeros(len(x))
        return x @ directions[:-1] + more[:, None] * directions[-1]

    def matrix(column) -> np.ndarray:
        flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
        return flat.to_numpy(zero_copy_only=False).reshape(-1, width)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = project(matrix(batch.column(0)), True)
                yield pa.record_batch([pa.array(y[:, j]) for j in range(dims)], [f"p{j}" for j in range(dims)])

    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE, LEAF_SAMPLE << depth)).select("x")
    drawn = drawn.mapInArrow(projected, ", ".join(f"p{j} double" for j in range(dims))).toArrow()
    tree = splits(np.stack([c.to_numpy() for c in drawn.columns], 1), depth)

    def deal(data: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    y = project(matrix(batch.column(1)), data)
                    yield pa.record_batch([batch.column(0), batch.column(1), pa.array(leaf_of(y, *tree), pa.int32()), *(pa.array(y[:, j]) for j in range(dims))], ["id", "x", "leaf", *(f"p{j}" for j in range(dims))])

        return run

    laid = "id long, x array<double>, leaf int, " + ", ".join(f"p{j} double" for j in range(dims))
    data = materialize(rows.mapInArrow(deal(True), laid), "ann-data")
    ends = [f(f"p{j}").alias(f"{n}{j}") for n, f in (("low", F.min), ("high", F.max)) for j in range(dims)]
    boxes = sorted(map(tuple, data.groupBy("leaf").agg(*ends).collect()))  # a row per leaf
    leaves = np.array([b[0] for b in boxes], np.int64)
    low, high = (np.array([b[1 + s * dims : 1 + (s + 1) * dims] for b in boxes], float) for s in (0, 1))
    asked = materialize(queries.mapInArrow(deal(False), laid).select("id", "x", "leaf"), "ann-queries")

    def near(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(other):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        q, x = np.stack(own["x"].to_numpy()), np.stack(other["x"].to_numpy())
        leaf = Leaf(other["id"].to_numpy(), x, project(x, True))
        out = []
        for a in range(0, len(q), 1024):
            gaps = box_distance(project(q[a : a + 1024], False), leaf.low, leaf.high)
            for j in range(len(gaps)):
                qid, v = int(own["id"].iloc[a + j]), q[a + j]
                ids, s = leaf.search(qid, v, gaps[j], k, float(own["bound"].iloc[a + j]), top + float(v @ v), chi)
                use = top + float(v @ v) - 2 * s <= float(own["bound"].iloc[a + j]) + 1e-9
                out.append((np.full(int(use.sum()), qid), ids[use], s[use]))
        return pd.DataFrame({"query_id": np.concatenate([o[0] for o in out]), "vec_id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

    def visit(routed: DataFrame) -> DataFrame:
        """routed: id, x, bound, leaf. A leaf's data go to as many tasks as its queries need."""
        need = materialize(routed.groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "ann-chunks")
        left = routed.join(need, "leaf").withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int")).drop("chunks")
        right = data.select("id", "x", "leaf").join(need, "leaf").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        return left.groupBy("leaf", "chunk").cogroup(right.groupBy("leaf", "chunk")).applyInPandas(lambda a, b: near(a, b), "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    found = materialize(visit(asked.withColumn("bound", F.lit(float("inf")))), "ann-near")
    if len(leaves) > 1:
        kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        again = asked.join(kth, F.col("id") == F.col("query_id"), "left").select("id", "x", "leaf", F.when(F.col("n") == k, F.col("least")).alias("least"))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                step = max(1, ROUTED // len(leaves))
                for part in (batch.slice(a, step) for a in range(0, batch.num_rows, step)):
                    x = matrix(part.column(1))
                    least = part.column(3).to_numpy(zero_copy_only=False).astype(float)
                    bound = np.where(np.isnan(least), np.inf, top + (x * x).sum(1) - 2 * least)
                    gaps = box_distance(project(x, False), low, high)
                    own = part.column(2).to_numpy(zero_copy_only=False)
                    i, j = np.nonzero((gaps <= bound[:, None] * chi) & (leaves[None, :] != own[:, None]))
                    yield pa.record_batch([part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i)), pa.array(bound[i]), pa.array(leaves[j], pa.int32())], ["id", "x", "bound", "leaf"])

        routed = materialize(again.mapInArrow(route, "id long, x array<double>, bound double, leaf int"), "ann-routed")
        found = found.unionByName(visit(routed))
    return ranked(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


SQL = None
