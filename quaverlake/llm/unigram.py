"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces and their log scores come from a vocabulary file. A file of unigram scores is used
as it is; a merge list has ranks for scores, which become log probabilities by Zipf's law,
-ln(rank + 1) - ln(H). Spaces become the marker U+2581, one marker is put in front, and the
best segmentation into pieces is found; a character that no piece covers costs the least
score minus 10 and becomes byte pieces. A marker that is already in the text is always
written as bytes, so decoding gives back every text.

No piece holds a marker behind another character, or a line break: segmentation falls apart
there exactly, words are looked up in a table, and all new words of a batch run through the
trie together, a numpy step per byte. Of equal scores the segmentation whose last piece is
longest wins, from right to left.

Defined cases: a null text gives null ids and an empty one no ids, repeated rows each get
their result, an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Segmented words that a worker keeps, and the longest word (in bytes) that is kept and runs with others.
CACHE = 250_000
TOGETHER = 64


class DoubleArray:
    """Trie of byte strings: child(s, b) is base[s] + b + 1 if check of that is s. value: number of the string that ends, or -1."""

    def __init__(self, strings: dict[bytes, int]):
        trie: dict = {}
        for s, v in strings.items():
            node = trie
            for b in s:
                node = node.setdefault(b, {})
            node[-1] = v
        room = 1024
        self.base, self.check, self.value = (np.full(room, x, np.int32) for x in (0, -1, -1))
        used = bytearray(room)
        used[0] = 1
        free, frontier, todo = 300, 300, [(trie, 0)]  # every code fits from there on
        while todo:
            node, at = todo.pop()
            self.value[at] = node.get(-1, -1)
            codes = sorted(b + 1 for b in node if b >= 0)
            if not codes:
                continue
            while used[free]:
                free += 1
                if free + 600 > room:
                    used, room = self._grow(used), room * 2
            # lone children fill holes; families move on behind a frontier, so that no search starts over
            pos = free if len(codes) == 1 else frontier
            while used[pos] or any(used[pos - codes[0] + c] for c in codes):
                pos += 1
                if pos + 600 > room:
                    used, room = self._grow(used), room * 2
            frontier = max(frontier, pos - 64) if len(codes) > 1 else frontier
            base = pos - codes[0]
            self.base[at] = base
            for c in codes:
                used[base + c] = 1
                self.check[base + c] = at
                todo.append((node[c - 1], base + c))
            if pos + 600 > room:
                used, room = self._grow(used), room * 2

    def _grow(self, used: bytearray) -> bytearray:
        n = len(used)
        self.base, self.check, self.value = (np.concatenate((a, np.full(n, x, np.int32))) for a, x in ((self.base, 0), (self.check, -1), (self.value, -1)))
        return used + bytearray(n)


class Unigram:
    """Pieces, log scores and their trie."""

    def __init__(self, pieces: dict[int, bytes], scores: dict[int, float], byte_ids: list[int], size: int):
        self.pieces = {**pieces, **{i: bytes([b]) for b, i in enumerate(byte_ids)}}
        self.byte_ids, self.size = byte_ids, size
        self.scores = np.full(size, -np.inf)
        for i, s in scores.items():
            self.scores[i] = s
        self.trie = DoubleArray({p: i for i, p in pieces.items()})
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        mark = MARK.encode()
        self.by_word = all(MARK not in p.decode().lstrip(MARK) for p in pieces.values())
        self.by_line = not any(b"\n" in p for p in pieces.values())
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.literal = tuple(byte_ids[b] for b in mark)
        end = "\n" if self.by_line else ""
        self.words = re.compile(f"{MARK}*[^{MARK}{end}]+|{MARK}+|\n" if self.by_word else f"[^{end}]+|\n" if end else "(?s).+")

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")} | {"cache": {}}

    def together(self, words: list[bytes]) -> None:
        """Segment words of similar length and put them into the cache."""
        n, lengths = len(words), np.array([len(w) for w in words])
        width = int(lengths.max())
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width).astype(np.int32)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        piece, back = np.full((n, width + 1), -1, np.int32), np.zeros((n, width + 1), np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        starts = (text & 0xC0) != 0x80
        size = np.where(text >= 0xF0, 4, np.where(text >= 0xE0, 3, np.where(text >= 0xC0, 2, 1)))
        for i in range(width):
            all_rows = np.flatnonzero((lengths > i) & starts[:, i])
            rows, state = all_rows, np.zeros(len(all_rows), np.int32)
            covered = np.zeros(n, bool)
            for j in range(i, width):
                t = base[state] + text[rows, j] + 1
                ok = (check[t] == state) & (lengths[rows] > j)
                rows, state = rows[ok], t[ok]
                if not len(rows):
                    break
                v = value[state]
                has = v >= 0
                if has.any():
                    r, v = rows[has], v[has]
                    covered[r[size[r, i] == j + 1 - i]] = True
                    s = best[r, i] + self.scores[v]
                    up = s > best[r, j + 1]
                    r = r[up]
                    best[r, j + 1], piece[r, j + 1], back[r, j + 1] = s[up], v[up], i
            rows = all_rows[~covered[all_rows]]
            if len(rows):
                e = i + size[rows, i]
                s = best[rows, i] + self.unknown
                up = s > best[rows, e]
                rows, e = rows[up], e[up]
                best[rows, e], piece[rows, e], back[rows, e] = s[up], -1, i
        rows, at, steps = np.arange(n), lengths.copy(), []
        while (live := at > 0).any():
            steps.append(np.where(live, piece[rows, at], -2))
            if (steps[-1] == -1).any():
                steps[-1] = np.where(steps[-1] == -1, -3 - (back[rows, at] * 8 + at - back[rows, at]), steps[-1])
            at = np.where(live, back[rows, at], 0)
        for w, own in zip(words, np.stack(steps[::-1], 1).tolist()):
            if min(own) >= 0:
                self.cache[w] = tuple(own)
            else:
                out: list[int] = []
                for x in own:
                    if x >= 0:
                        out.append(x)
                    elif x <= -3:
                        a, k = divmod(-3 - x, 8)
                        out += (self.byte_ids[b] for b in w[a : a + k])
                self.cache[w] = tuple(out)

    def alone(self, w: bytes) -> tuple[int, ...]:
        """Segment one long word: the same recurrence a step at a time."""
        if "_lists" not in self.__dict__:  # once a worker
            self._lists = [x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value, self.scores)]
        (base, check, value, scores), n = self._lists, len(w)
        best, piece, back = [-np.inf] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            b = w[i]
            if b & 0xC0 == 0x80:
                continue
            size = 4 if b >= 0xF0 else 3 if b >= 0xE0 else 2 if b >= 0xC0 else 1
            state, covered, here = 0, False, best[i]
            for j in range(i, n):
                t = base[state] + w[j] + 1
                if check[t] != state:
                    break
                state = t
                if (v := value[t]) >= 0:
                    covered |= j + 1 - i == size
                    if here + scores[v] > best[j + 1]:
                        best[j + 1], piece[j + 1], back[j + 1] = here + scores[v], v, i
            if not covered and here + self.unknown > best[i + size]:
                best[i + size], piece[i + size], back[i + size] = here + self.unknown, -1, i
        out: list[int] = []
        at = n
        while at:
            a = back[at]
            out += [piece[at]] if piece[at] >= 0 else [self.byte_ids[b] for b in reversed(w[a:at])]
            at = a
        return tuple(reversed(out))

    def split(self, text: str) -> list[str | None]:
        """Marked words of a text; None stands for a marker of the text itself."""
        first, *rest = text.split(MARK)
        out: list[str | None] = self.words.findall(MARK + first.replace(" ", MARK)) if text else []
        for part in rest:
            out.append(None)
            out += self.words.findall(part.replace(" ", MARK))
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.split(t) for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        known = self.cache
        new = {w for ws in split for w in ws} - known.keys() - {None}
        by_length: dict[int, list[str]] = {}
        passing: list[str] = []  # long words rarely come again
        for w in new:
            by_length.setdefault(-(-len(w.encode()) // 8), []).append(w)
        for k, ws in by_length.items():
            if k * 8 <= TOGETHER:
                for a in range(0, len(ws), 4096):
                    part = ws[a : a + 4096]
                    coded = [w.encode() for w in part]
                    self.together(coded)
                    for w, c in zip(part, coded):
                        known[w] = known.pop(c)
            else:
                passing += ws
                for w in ws:
                    known[w] = self.alone(w.encode())
        known[None] = self.literal
        coded = [np.fromiter(chain.from_iterable(map(known.__getitem__, ws)), np.int32) for ws in split]
        for w in passing:
            del known[w]
        return coded

    def decode(self, ids) -> str:
        """Pieces put together, their markers made spaces, the first one dropped; byte pieces stay as they are."""
        if not len(ids):
            return ""
        mark, table = MARK.encode(), self.decoded()
        return b"".join(map(table.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")[1 if self.pieces[int(ids[0])].startswith(mark) else 0 :]

    def decoded(self) -> dict[int, bytes]:
        if "_decoded" not in self.__dict__:
            mark, raw = MARK.encode(), set(self.byte_ids)
            self._decoded = {i: p if i in raw else p.replace(mark, b" ") for i, p in self.pieces.items()}
        return self._decoded


def load(path: str = VOCABULARY) -> Unigram:
    """Read a SentencePiece model file on the driver; nothing is trained."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.vocab_size()
    normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    scores = {i: sp.get_score(i) for i in normal}
    if all(float(s).is_integer() for s in scores.values()):
        order = sorted(normal, key=lambda i: (-scores[i], i))
        harmonic = float(np.log(sum(1 / (r + 1) for r in range(len(order)))))
        scores = {i: -float(np.log(r + 1)) - harmonic for r, i in enumerate(order)}
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Unigram({i: sp.id_to_piece(i).encode() for i in normal}, scores, byte_ids, size)


def encode(df: DataFrame, model: Unigram | None = None, text: str = "text", keep: list[str] | None = None, column: str = "ids") -> DataFrame:
    """The columns `keep` (all) plus ids; of the same name, the old column is replaced."""
    keep = [n for n in (df.columns if keep is None else keep) if n != column]
    shared = df.sparkSession.sparkContext.broadcast(model or load())  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = part.column(len(keep)).to_pylist()
                coded = shared.value.encode_batch([t or "" for t in texts])
                offsets = np.concatenate(([0], np.cumsum([len(c) for c in coded]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(coded)), mask=pa.array([t is None for t in texts]))
                yield pa.record_batch([*part.columns[:-1], ids], [*keep, column])

    kept = df.select(*keep)
    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, kept.schema.add(column, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, model: Unigram | None = None, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """df plus the text that ids stand for."""
    keep = [n for n in df.columns if n != column]
    shared = df.sparkSession.sparkContext.broadcast(model or load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                lists = part.column(len(keep))
                out = [shared.value.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in lists]
                yield pa.record_batch([*part.columns[:-1], pa.array(out, pa.string())], [*keep, column])

    return df.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, df.select(*keep).schema.add(column, "string"))


def round_trip(df: DataFrame, model: Unigram | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, n_bytes (byte pieces), ids_sha256 (little-endian int32) and lossless (decoding gives the text)."""
    import hashlib

    shared = df.sparkSession.sparkContext.broadcast(model or load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                m = shared.value
                raw = np.zeros(m.size, bool)
                raw[m.byte_ids] = True
                coded = m.encode_batch(texts)
                cols = [[len(c) for c in coded], [int(raw[c].sum()) for c in coded], [hashlib.sha256(c.astype("<i4").tobytes()).hexdigest() for c in coded], [m.decode(c) == t for c, t in zip(coded, texts)]]
                yield pa.record_batch([part.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.bool_())))], [key, "n_tokens", "n_bytes", "ids_sha256", "lossless"])

    kept = df.select(key)
    schema = kept.schema.add("n_tokens", "long").add("n_bytes", "long").add("ids_sha256", "string").add("lossless", "boolean")
    return df.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))


SQL = None
