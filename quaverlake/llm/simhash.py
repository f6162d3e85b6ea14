"""Near duplicates by SimHash and the generalised pigeonhole principle.

Fingerprints: XXH64 of 4-word shingles, a bit is set if it is set in over half of them.
Distinct fingerprints that differ in at most `tau` bits are found without comparing all:

1. bits that go together over all fingerprints are grouped into m partitions;
2. a dynamic program gives each partition a threshold t_i with sum(t_i + 1) = tau + 1, so
   that any two near fingerprints differ in at most t_i bits of some partition i; it
   minimises the candidates and probes estimated from the counts of all partition values;
   m is the number of partitions that costs least;
3. each fingerprint is stored under its value per partition and probes all values within
   t_i; probes are verified on the 64 bits where they meet, and each task only returns a
   spanning forest of its links, so that a group of n copies gives n - 1 links;
4. values that over `tile` fingerprints share are dealt into tiles, each met by all probes;
5. components of the links (large-star, small-star) give the smallest reachable document.

Exact: no link is lost. Nodes are the distinct fingerprints, so equal ones are merged before
anything else. The number of partitions is part of the dynamic program and grows in steps as
fingerprints do: a change of plan is not a change of results.

Defined cases: null and empty texts have fingerprint zero and link like any other; a null
doc_id links like any other but names no component (one of null doc_ids only is null); texts
that share a doc_id are told apart; repeated rows each get their result, and keep_first keeps
one of them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialize, null_safe_text, packed, partitions, read_table, unpacked

TAU = 4
SHINGLE = 4
SEED = 42
#: Fingerprints under one partition value that are met in one group.
TILE = 4096
#: At most so many partitions are weighed against each other, and what a probe costs in candidates:
#: a row that is exploded, shuffled and sorted took 2 to 4 us, a comparison 44 ns (both measured).
MOST_PARTITIONS = 12
PROBE_COST = 64.0
#: Pairs that are compared at once, probes of a key that are held, and nodes whose trees a task remembers.
PAIRS = 1 << 21
HELD = 1 << 16
FOREST = 1 << 20

_BITS = np.array([[v >> b & 1 for b in range(8)] for v in range(256)], np.int64)


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """SimHash of the whole text: ASCII lower case, words between ASCII white space."""
    w = text.lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[k:] for k in range(n)))) if len(w) >= n else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, max(1, len(w) - n + 1))
    lanes = h.view(np.uint8).reshape(-1, 8)
    if len(h) < 256:
        ones = np.unpackbits(lanes, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` and fp, the fingerprint as a signed long."""
    keep = df.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in batch.column(len(keep)).cast(pa.binary())]
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.record_batch([*(batch.column(k) for k in range(len(keep))), fp], [*keep, "fp"])

    kept = df.select(*keep)
    schema = kept.schema.add("fp", "long")
    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


# --- the plan of partitions and thresholds

def correlated_groups(corr: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m groups of nearly equal size; each grows by the bit that goes best with it."""
    corr, free, out = np.abs(corr), set(range(64)), []
    for k in range(m):
        room = len(free) // (m - k)
        order = sorted(free)
        group = [max(order, key=lambda b: (corr[b, order].sum(), -b))]
        free.discard(group[0])
        while len(group) < room:
            best = max(sorted(free), key=lambda b: (corr[b, group].mean(), -b))
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def allocate(costs: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = tau + 1 and the least sum of costs[i][t_i + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for a, c in enumerate(own):
                if used + a <= tau + 1 and (used + a not in after or cost + c < after[used + a][0]):
                    after[used + a] = (cost + c, [*ts, a - 1])
        best = after
    return best.get(tau + 1, (float("inf"), []))


def _ball(width: int, t: int) -> int:
    n, c = 0, 1
    for k in range(t + 1):
        n, c = n + c, c * (width - k) // (k + 1)
    return n


def plan(fps: DataFrame, tau: int = TAU) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition, from statistics over all fingerprints."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(64, np.int64), np.zeros((64, 64), np.int64)
        for batch in batches:
            x = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            n, one, two = n + len(x), one + x.sum(0).astype(np.int64), two + (x.T @ x).astype(np.int64)
        flat = np.concatenate(([n], one, two.ravel()))
        yield pa.record_batch([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["i", "v"])

    got = np.zeros(1 + 64 + 64 * 64)
    for r in fps.select("fp").mapInArrow(moments, "i int, v long").groupBy("i").agg(F.sum("v")).collect():  # 4161 rows
        got[r[0]] = r[1]
    n = got[0]
    if n < 2:
        return []
    mean = got[1:65] / n
    cov = got[65:].reshape(64, 64) / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = cov / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    options = {m: correlated_groups(corr, m) for m in range(1 if tau == 0 else 2, min(tau + 1, MOST_PARTITIONS) + 1)}
    values = F.array(*[F.struct(F.lit(100 * m + k).alias("o"), F.col("fp").bitwiseAND(_mask(g)).alias("v")) for m, gs in options.items() for k, g in enumerate(gs)])
    counts = fps.select(F.explode(values).alias("x")).groupBy("x.o", "x.v").count()
    pairs = dict(counts.groupBy("o").agg(F.sum(F.col("count").cast("double") * F.col("count"))).collect())
    m, ts = plan_of(n, {m: [pairs[100 * m + k] for k in range(m)] for m in options}, {m: [len(g) for g in gs] for m, gs in options.items()}, tau)
    return [(g, t) for g, t in zip(options[m], ts) if t >= 0]


def _mask(bits) -> int:
    v = sum(1 << b for b in bits)
    return v - (1 << 64) if v >> 63 else v


# --- links

def _probes(part: int, bits: list[int], flips: list[int]):
    return F.transform(F.array(*map(F.lit, flips)), lambda f: F.struct(F.lit(part).alias("part"), F.col("fp").bitwiseXOR(f).bitwiseAND(F.lit(_mask(bits))).alias("value"), F.lit(True).alias("probe")))


def plan_of(n: float, pairs: dict[int, list[float]], widths: dict[int, list[int]], tau: int) -> tuple[int, list[int]]:
    """(m, thresholds) of least cost for n fingerprints; pairs and widths per number of partitions m."""
    best = (float("inf"), 0, [])
    for m, w in widths.items():
        cost, ts = allocate([[0.0, *(_ball(w[k], t) * (n * PROBE_COST + pairs[m][k]) for t in range(tau + 1))] for k in range(m)], tau)
        best = min(best, (cost, m, ts), key=lambda b: b[0])
    if not best[2]:
        raise ValueError(f"no plan for {tau} bits")
    return best[1], best[2]


def links(fps: DataFrame, tau: int = TAU, tile: int = TILE) -> DataFrame:
    """fps: distinct (fp, rep). Returns (a, b): reps whose links span all components of fingerprints within tau bits."""
    parts = plan(fps, tau)
    spark = fps.sparkSession
    if not parts:
        return spark.createDataFrame([], "a long, b long")
    own = F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(_mask(g)).alias("value"), F.lit(False).alias("probe")) for k, (g, _) in enumerate(parts)])
    near = []
    for k, (g, t) in enumerate(parts):
        flips = [_mask(c) for r in range(t + 1) for c in combinations(g, r)]
        near.append(_probes(k, g, flips))
    stored = fps.select("fp", "rep", F.explode(own).alias("x")).select("fp", "rep", "x.*")
    hot = materialize(stored.groupBy("part", "value").count().where(F.col("count") > tile).select("part", "value", F.ceil(F.col("count") / tile).cast("int").alias("tiles")), "simhash-hot")
    rows = fps.select("fp", "rep", F.explode(F.concat(own, *near)).alias("x")).select("fp", "rep", "x.*").join(hot, ["part", "value"], "left")
    tiles = F.coalesce("tiles", F.lit(1))
    cells = F.when(F.col("probe"), F.sequence(F.lit(0), tiles - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), tiles).cast("int")))
    rows = rows.select("fp", "rep", "part", "value", "probe", F.explode(cells).alias("cell"))
    rows = rows.select(F.xxhash64("part", "value", "cell").alias("key"), "probe", "fp", "rep")
    rows = rows.repartition(partitions(spark), "key").sortWithinPartitions("key", "probe")
    return rows.mapInArrow(lambda batches: _meet(batches, tau), "a long, b long")


def _meet(batches: Iterator[pa.RecordBatch], tau: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, stored before probing ones. Returns a spanning forest of the links of this task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while (up := root.get(x, x)) != top:
            root[x] = top
            x = up
        return top

    def joined(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        new = []
        for x, y in both.tolist():
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                new.append((x, y))
        return pa.record_batch([pa.array([e[0] for e in new], pa.int64()), pa.array([e[1] for e in new], pa.int64())], ["a", "b"])

    def compared(fp, rep, i, j) -> pa.RecordBatch | None:
        ok = (np.bitwise_count(fp[i] ^ fp[j]) <= tau) & (rep[i] != rep[j])
        return joined(rep[i[ok]], rep[j[ok]]) if ok.any() else None

    def runs(key, probe, fp, rep) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        last = np.concatenate((first[1:], [len(key)]))
        stored = np.add.reduceat(~probe, first, dtype=np.int64)
        total = last - first
        use = np.flatnonzero((stored > 0) & (total > stored) & (total > 1))
        pairs = stored[use] * (total[use] - stored[use])
        small = use[pairs <= PAIRS]
        cut = np.cumsum(pairs[pairs <= PAIRS]) // PAIRS
        for c in np.unique(cut):
            u = small[cut == c]
            s, p = stored[u], total[u] - stored[u]
            n = s * p
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i = np.repeat(first[u], n) + at // np.repeat(p, n)
            j = np.repeat(first[u] + s, n) + at % np.repeat(p, n)
            if (out := compared(fp, rep, i, j)) is not None:
                yield out
        for u in use[pairs > PAIRS]:
            mid = first[u] + stored[u]
            step = max(1, PAIRS // int(last[u] - mid))
            for a in range(first[u], mid, step):
                i = np.arange(a, min(a + step, mid))
                j = np.arange(mid, last[u])
                if (out := compared(fp, rep, np.repeat(i, len(j)), np.tile(j, len(i)))) is not None:
                    yield out

    kept: list[np.ndarray] | None = None
    for batch in batches:
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        now[2] = now[2].view(np.uint64)
        if not len(now[0]):
            continue
        now = now if kept is None else [np.concatenate(x) for x in zip(kept, now)]
        start = int(np.searchsorted(now[0], now[0][-1]))
        if start:
            yield from runs(*(x[:start] for x in now))
        kept = [x[start:] for x in now]
        stored = int(np.searchsorted(kept[1], True))  # they come before the probes of their key
        if len(kept[0]) - stored > HELD:
            yield from runs(*kept)
            kept = [x[:stored] for x in kept]
        if len(root) > FOREST:
            root.clear()  # some links may then be given out again
    if kept is not None:
        yield from runs(*kept)


def components(fingerprints: DataFrame, key: str = "doc_id", tau: int = TAU, tile: int = TILE) -> DataFrame:
    """(fp, root, component_id) of every distinct fp: root tells components apart, component_id is their smallest key."""
    fps = materialize(fingerprints.groupBy("fp").agg(F.min(F.col(key).cast("long")).alias("least")), "simhash-fps")
    found = connected_components(links(fps.select("fp", F.col("fp").alias("rep")), tau, tile))
    rooted = fps.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-roots")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(names, "root").select("fp", "root", "component_id")


def group(df: DataFrame, key: str = "doc_id", text: str = "text", tau: int = TAU) -> DataFrame:
    """Per row: doc_id, fp, root and component_id (null only if no row of the component has a key)."""
    own = df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("__text"), F.xxhash64(null_safe_text(text)).alias("__h"))
    prints = materialize(with_fingerprints(own, "__text", ["doc_id", "__h"]), "simhash-docs")
    return prints.join(components(prints, "doc_id", tau), "fp").select("doc_id", "fp", "root", "component_id", "__h")


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", tau: int = TAU) -> DataFrame:
    """df with one row of each group: that of the smallest key (null last), then fingerprint, then hash of the text.

    Rows that agree in key and text are copies, of which any one stays.
    """
    rows = group(df, key, text, tau).groupBy("root", "doc_id", "fp", "__h").agg(F.count("*").alias("n"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "__h", "n")).alias("b"))
    stays = materialize(best.select("b.doc_id", "b.__h", "b.n"), "simhash-stays")
    marked = packed(df, own_key=F.col(key), own_hash=F.xxhash64(null_safe_text(text)))
    kept = marked.join(stays, F.col("own_key").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("__h")), "left_semi")
    if not stays.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["own_key", "own_hash"])
    return unpacked(kept, df.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = group(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SQL = None
