"""Runs, spans and alignments over ordered rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming import Padding, Windows, over_table

MATCH_LEAST, GAP = 0.34, -0.45
LINE_MS = 2600
GAP_MS, LINE_WORDS = 700, 14
PAD_MS, WINDOW_MS = 30, 30_000
MEDIAN_FRAMES = 7


def smooth_runs(df: DataFrame, by: str, order: list[str], value: str, least: int) -> DataFrame:
    """Runs shorter than `least`, but for the first, take the last value kept before them."""
    w = Window.partitionBy(by).orderBy(*order)
    new = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    out = df.withColumn("__new", F.when(F.row_number().over(w) == 1, 1).otherwise(new)).withColumn("__run", F.sum("__new").over(w))
    out = out.withColumn("__n", F.count("*").over(Window.partitionBy(by, "__run")))
    kept = F.when((F.col("__n") >= least) | (F.col("__run") == 1), F.struct(value))
    return out.withColumn("smoothed", F.last(kept, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))[value]).drop("__new", "__run", "__n")


def majority_fill(df: DataFrame, by: str, cluster: str, value: str, unknown: int = -1) -> DataFrame:
    """Unknown values take the most frequent known value of their cluster; of equal counts the smallest."""
    known = df.where((F.col(value) != unknown) & F.col(cluster).isNotNull()).groupBy(by, cluster, value).count()
    w = Window.partitionBy(by, cluster).orderBy(F.desc("count"), value)
    top = known.withColumn("r", F.row_number().over(w)).where("r = 1").select(by, cluster, F.col(value).alias("__top"))
    out = df.join(top, [by, cluster], "left")
    return out.withColumn("refined", F.when((F.col(value) == unknown) & F.col("__top").isNotNull(), F.col("__top")).otherwise(F.col(value))).drop("__top")


def valid_indices(values: Column, expected: Column, count: Column) -> Column:
    """The array with out-of-range entries as -1; null if its length isn't `expected`."""
    return F.when(F.size(values) == expected, F.transform(values, lambda v: F.when((v >= 0) & (v < count), v).otherwise(F.lit(-1).cast("long"))))


def words_to_lines(words: DataFrame, by: str, start: str = "start_ms", end: str = "end_ms", word: str = "word", gap: int = GAP_MS, most: int = LINE_WORDS) -> DataFrame:
    """(by, line_no, start, end, text): a new line after a pause over `gap` or `most` words."""
    w = Window.partitionBy(by).orderBy(start, end, word)
    pause = F.coalesce((F.col(start) - F.lag(end).over(w) > gap).cast("int"), F.lit(1))
    rows = words.withColumn("__b", pause).withColumn("__p", F.sum("__b").over(w))
    inner = Window.partitionBy(by, "__p").orderBy(start, end, word)
    rows = rows.withColumn("__l", F.floor((F.row_number().over(inner) - 1) / most))
    parts = F.array_sort(F.collect_list(F.struct(start, end, word)))
    lines = rows.groupBy(by, "__p", "__l").agg(F.min(start).alias(start), F.max_by(end, F.struct(start, end, word)).alias(end), F.array_join(F.transform(parts, lambda x: x[word]), " ").alias("text"))
    return lines.select(by, (F.row_number().over(Window.partitionBy(by).orderBy("__p", "__l")) - 1).alias("line_no"), start, end, "text")


def merge_touching(spans: DataFrame, by: str, label: str, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Spans of the same label that touch or overlap their predecessor become one."""
    w = Window.partitionBy(by).orderBy(start, end, label)
    new = ~(F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.col(start) <= F.lag(end).over(w)))
    rows = spans.withColumn("__n", F.coalesce(new, F.lit(True)).cast("int")).withColumn("__g", F.sum("__n").over(w))
    return rows.groupBy(by, label, "__g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__g")


def diarise_windows(spans: DataFrame, start: str = "start_ms", end: str = "end_ms", width: int = 1500, hop: int = 750, least: int = 500) -> DataFrame:
    """spans cut in windows of `width` every `hop`; what is left at the end counts from `least` on."""
    at = F.explode(F.sequence(F.col(start), F.greatest(F.col(start), F.col(end) - least), F.lit(hop).cast("long")))
    out = spans.where(F.col(end) - F.col(start) >= least).select("*", at.alias("w_start"))
    return out.withColumn("w_end", F.least(F.col("w_start") + width, F.col(end))).where(F.col("w_end") - F.col("w_start") >= least)


def repetition_overrun(ids: Column) -> Column:
    """How many ids to drop at the end: 12 if they repeat with a period of 1 to 4, else three periods if a longer one (to 24) stands four times; null: none."""
    def repeats(length: int, period: int) -> Column:
        tail = F.slice(ids, -length, length)
        return (F.size(ids) >= length) & (F.slice(tail, period + 1, length - period) == F.slice(tail, 1, length - period))

    out = F.when(repeats(12, 1), 12)
    for p in (2, 3, 4):
        out = out.when(repeats(12, p), 12)
    for p in range(5, 25):
        out = out.when(repeats(4 * p, p), 3 * p)
    return out


def pad_spans(spans: DataFrame, by: str, total: str, pad: int = PAD_MS) -> DataFrame:
    """Spans (start_ms, end_ms, by start) widened by `pad`; where two would meet, the middle divides them.

    What a span starts at depends on the span before as already changed: a fold over a key's sorted spans, of which a task holds one.
    """
    known = spans.where("start_ms is not null and end_ms is not null").withColumn("total", F.col(total))
    return over_table(known, Padding(pad), by)


def plan_windows(spans: DataFrame, by: str, width: int = WINDOW_MS) -> DataFrame:
    """Windows of at most `width` that cover all spans in order; a span that is too long is cut."""
    return over_table(spans.where("start_ms is not null and end_ms is not null"), Windows(width), by)


def disjoint(spans: DataFrame, by: str, label: str) -> DataFrame:
    """(by, label, start_ms, end_ms): overlaps of neighbours (by start, end and label) divided in the middle; spans that become empty go.

    A middle depends on the two spans as given, so no fold is needed.
    """
    w = Window.partitionBy(by).orderBy("start_ms", "end_ms", label)
    start, end = F.col("start_ms"), F.col("end_ms")
    before, after = F.lag(end).over(w), F.lead(start).over(w)
    middle = lambda a, b: F.floor((a + b) / 2).cast("long")
    cut = spans.select(by, F.col(label).alias("label"), F.when(start < before, middle(start, before)).otherwise(start).alias("start_ms"), F.when(after < end, middle(after, end)).otherwise(end).alias("end_ms"))
    return cut.where("end_ms > start_ms")


def _diagonals(n: int, m: int):
    """The cells of a matrix by anti-diagonals, counted from 1: those of one don't depend on each other."""
    for total in range(2, n + m + 1):
        i = np.arange(max(1, total - m), min(n, total - 1) + 1)
        yield i, total - i


#: Similarities and penalties of alignments are whole numbers of this share, so that ties are ties.
UNIT = 10**9


def _aligned(n: int, m: int, similar: Callable[[int], np.ndarray], least: float, gap: float) -> list[int]:
    """For each of n rows its column, or -1. similar(i): what a row has in common with each column, in UNIT.

    Only every k-th row of sums is kept, for k * k about n; on the way back the rows between two of them are made again with
    their moves, so memory is n^(1/2) * m numbers and not n * m.
    """
    low, step = int(round(least * UNIT)), int(round(gap * UNIT))
    edge = np.arange(m + 1, dtype=np.int64) * step

    def after(best: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = similar(i)
        diagonal, up = best[:-1] + own - low, best[1:] + step
        other = np.concatenate(([best[0] + step], np.maximum(diagonal, up)))
        return np.maximum.accumulate(other - edge) + edge, diagonal, up  # steps to the left from the best cell before

    each = max(1, int(np.sqrt(n)))
    kept, best = [edge], edge
    for i in range(n):
        best = after(best, i)[0]
        if (i + 1) % each == 0:
            kept.append(best)
    out, i, j = [-1] * n, n, m
    while i and j:
        first = (i - 1) // each * each
        best, moves = kept[first // each], []
        for r in range(first, i):
            best, diagonal, up = after(best, r)
            left = best[:-1] + step
            moves.append(np.where((diagonal >= up) & (diagonal >= left), 0, np.where(up >= left, 1, 2)).astype(np.int8))
        while i > first and j:
            move = moves[i - 1 - first][j - 1]
            if move != 1:
                j -= 1
            if move != 2:
                i -= 1
            if move == 0 and similar(i)[j] >= low:
                out[i] = j
    return out


def align(similarity: np.ndarray, least: float = MATCH_LEAST, gap: float = GAP) -> list[int]:
    """Global alignment: for each row its column or -1. Ties prefer the diagonal, then up, then left."""
    return _aligned(*similarity.shape, lambda i: np.floor(similarity[i] * UNIT).astype(np.int64), least, gap)


def align_tokens(rows: list, columns: list, least: float = MATCH_LEAST, gap: float = GAP) -> list[int]:
    """align() of lists of tokens by what their sets share, over the larger set's size; no matrix of that is made."""
    found: dict[str, list[int]] = {}
    for j, c in enumerate(columns):
        for t in set(c):
            found.setdefault(t, []).append(j)
    places = {t: np.array(p) for t, p in found.items()}
    sizes = np.array([len(set(c)) for c in columns], np.int64)

    def similar(i: int) -> np.ndarray:
        own = set(rows[i])
        met = [places[t] for t in own if t in places]
        shared = np.bincount(np.concatenate(met), minlength=len(columns)) if met else np.zeros(len(columns), np.int64)
        return np.floor(shared / np.maximum(np.maximum(sizes, len(own)), 1) * UNIT).astype(np.int64)

    return _aligned(len(rows), len(columns), similar, least, gap)


def interpolate(times: list[int | None], duration: int, step: int = LINE_MS) -> list[int]:
    """Times of all lines from those of the anchored ones: even steps between, fixed steps before, an even tail; strictly rising."""
    n, known = len(times), [i for i, t in enumerate(times) if t is not None]
    near = lambda x: int(np.floor(x + 0.5))
    if not known:
        span = duration if duration > 0 else n * step
        return [near(span / (n + 1) * (i + 1)) for i in range(n)]
    out = list(times)
    for i in range(known[0] - 1, -1, -1):
        out[i] = max(0, out[i + 1] - step)
    for a, b in zip(known, known[1:]):
        for i in range(a + 1, b):
            out[i] = out[a] + near((out[b] - out[a]) / (b - a) * (i - a))
    a = known[-1]
    end = duration if duration > out[a] else out[a] + (n - 1 - a) * step
    for i in range(a + 1, n):
        out[i] = out[a] + near((end - out[a]) / (n - a) * (i - a))
    last = -1
    for i in range(n):
        last = out[i] = max(out[i], 0, last + 1)
    return out


def align_lines(lines: DataFrame, cues: DataFrame, by: str, duration_ms: int = 0) -> DataFrame:
    """lines (by, line_no, tokens), cues (by, cue_no, time_ms, tokens) -> (by, line_no, cue_no or -1, time_ms, coverage).

    A text is a group: its lines and cues, and cues x the root of lines numbers (a text of 100,000 lines and cues: 250 MB).
    """
    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("line_no"), b.sort_values("cue_no")
        names = [by, "line_no", "cue_no", "time_ms", "coverage"]
        if not len(a):
            return pd.DataFrame(columns=names).astype({by: "int64", "line_no": "int64", "cue_no": "int64", "time_ms": "int64", "coverage": "float64"})
        hit = align_tokens(a["tokens"].to_list(), b["tokens"].to_list())
        times = [None if h < 0 else int(b["time_ms"].iloc[h]) for h in hit]
        return pd.DataFrame({by: a[by], "line_no": a["line_no"], "cue_no": [-1 if h < 0 else int(b["cue_no"].iloc[h]) for h in hit], "time_ms": interpolate(times, duration_ms), "coverage": sum(h >= 0 for h in hit) / len(hit)})[names]

    return lines.groupBy(by).cogroup(cues.groupBy(by)).applyInPandas(both, f"{by} long, line_no long, cue_no long, time_ms long, coverage double")


def time_warp(cost: np.ndarray) -> list[tuple[int, int]]:
    """The cheapest monotone path through a cost matrix (rows: tokens, columns: frames); ties: diagonal, row, column."""
    n, m = cost.shape
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0
    move = np.zeros((n + 1, m + 1), np.int8)
    for i, j in _diagonals(n, m):
        choice = np.stack((total[i - 1, j - 1], total[i - 1, j], total[i, j - 1]))
        move[i, j], total[i, j] = choice.argmin(0), choice.min(0) + cost[i - 1, j - 1]
    path, i, j = [], n, m
    while i and j:
        path.append((i - 1, j - 1))
        step = move[i, j]
        i, j = i - (step != 2), j - (step != 1)
    return path[::-1]


def attention_cost(weights: np.ndarray, width: int = MEDIAN_FRAMES) -> np.ndarray:
    """weights (heads, tokens, frames) -> (tokens, frames): what is attended more than by other tokens costs less.

    Each head's frame is scored over its tokens (deviation of the sample; one token or equal ones stay as they are), each row
    is a running median with mirrored ends (rows shorter than `width` stay), and the heads' mean is negated.
    """
    w = np.asarray(weights, float)
    if w.shape[1] > 1:
        sd = w.std(1, ddof=1, keepdims=True)
        w = np.where(sd > 1e-12, (w - w.mean(1, keepdims=True)) / np.where(sd > 1e-12, sd, 1), w)
    if w.shape[2] >= width > 1:
        mirrored = np.pad(w, ((0, 0), (0, 0), (width // 2, width // 2)), mode="reflect")
        w = np.median(np.lib.stride_tricks.sliding_window_view(mirrored, width, axis=2), axis=3)
    return -w.mean(0)


def first_frames(path: list[tuple[int, int]]) -> list[int]:
    """The frame at which a path reaches each row; paths pass all rows."""
    return [frame for k, (row, frame) in enumerate(path) if not k or path[k - 1][0] != row]


def attention_frames(rows: DataFrame, by: str, heads: list[int] | None = None, digits: int = 9) -> DataFrame:
    """rows (by, head, token, weights: one number a frame) of windows of speech -> (by, token, frame at which it starts).

    Only `heads` are read, or all; every head must have the same tokens. A window has at most some hundred tokens and 1,500
    frames, whatever the table: that is a group. Costs are rounded to `digits`, so that ties are settled by the rule (diagonal,
    token, frame) and not by the last bit. Rows without weights are left out, and a token with a row missing is an error.
    """
    kinds = {n: rows.schema[n].dataType.simpleString() for n in (by, "token")}
    used = rows.where(F.size("weights") > 0) if heads is None else rows.where((F.size("weights") > 0) & F.col("head").isin(heads))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["head", "token"])
        tokens = np.unique(part["token"])
        stacked = np.stack(part["weights"].to_list()).reshape(-1, len(tokens), len(part["weights"].iloc[0]))
        found = first_frames(time_warp(np.round(attention_cost(stacked), digits)))
        return pd.DataFrame({by: part[by].iloc[0], "token": tokens, "frame": found})

    return used.select(by, "head", "token", "weights").groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, token {kinds['token']}, frame int")


def warped(rows: DataFrame, by: str, row: str, costs: str) -> DataFrame:
    """rows (by, row, costs: one number a column) -> (by, i, row, column) of the cheapest monotone path; a matrix is a group."""
    kind = rows.schema[by].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(row)
        path = time_warp(np.stack(part[costs].to_list()))
        return pd.DataFrame([(part[by].iloc[0], k, *step) for k, step in enumerate(path)], columns=[by, "i", "row", "column"])

    return rows.where(F.size(costs) > 0).select(by, row, costs).groupBy(by).applyInPandas(run, f"{by} {kind}, i int, row int, column int")


def cluster(vectors: np.ndarray, seconds: np.ndarray, floor: float = 0.55, most: int = 6, shortest: float = 3.0, target: int | None = None) -> list[int]:
    """Agglomerative clusters by cosine of centroids, numbered by first appearance.

    Merging stops below `floor` once at most `most` are left, or at `target` (from 1 to `most`); clusters under `shortest` seconds
    join the nearest, of equally near ones the last.
    """
    target = None if target is None else min(max(target, 1), most)
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) > 0 else v
    groups: list = [([i], unit(v), float(s)) for i, (v, s) in enumerate(zip(vectors, seconds))]
    alive, centres = np.ones(len(groups), bool), np.stack([unit(g[1]) for g in groups])
    # similarities of each group to the later ones; a merge renews one row and one column
    sim = np.where(np.triu(np.ones((len(groups),) * 2, bool), 1), centres @ centres.T, -np.inf)
    at = sim.argmax(1)
    top = sim[np.arange(len(groups)), at]

    def join(i: int, j: int) -> None:
        a, b = groups[i], groups[j]
        n, m = len(a[0]), len(b[0])
        groups[i], groups[j], alive[j] = (a[0] + b[0], (a[1] * n + b[1] * m) / (n + m), a[2] + b[2]), None, False
        centres[i] = unit(groups[i][1])
        own = np.where(alive, centres @ centres[i], -np.inf)
        sim[j, :] = sim[:, j] = -np.inf
        sim[:i, i], sim[i, i + 1 :] = own[:i], own[i + 1 :]
        for k in {i, j, *np.flatnonzero((at == i) | (at == j) | (sim[:, i] >= top)).tolist()}:
            at[k] = sim[k].argmax()
            top[k] = sim[k, at[k]]

    while alive.sum() > (target or 1):
        i = int(top.argmax())
        if target is None and top[i] < floor and alive.sum() <= most:
            break
        join(i, int(at[i]))
    while target is None and alive.sum() > 1 and min(groups[g][2] for g in np.flatnonzero(alive)) < shortest:
        k = min(np.flatnonzero(alive), key=lambda g: groups[g][2])
        others = np.where(alive, centres @ centres[k], -np.inf)
        others[k] = -np.inf
        i = len(others) - 1 - int(others[::-1].argmax())
        join(min(i, int(k)), max(i, int(k)))
    label = {}
    for number, g in enumerate(sorted((g for g in groups if g), key=lambda g: min(g[0]))):
        label |= dict.fromkeys(g[0], number)
    return [label[i] for i in range(len(vectors))]


def cluster_windows(df: DataFrame, by: str, order: str, vector: str, seconds: float = 1.5) -> DataFrame:
    """(by, order, cluster) per recording; recordings are bounded by their length, so a group is one recording's windows."""
    kind = df.schema[by].dataType.simpleString()

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order)
        return pd.DataFrame({by: p[by], order: p[order], "cluster": cluster(np.stack(p[vector].to_numpy()), np.full(len(p), seconds))})

    return df.select(by, order, vector).groupBy(by).applyInPandas(fold, f"{by} {kind}, {order} long, cluster int")
