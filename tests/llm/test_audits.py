"""Filter audit, source divergence and MinHash groups against plain versions of their rules, and the cases of their docstrings."""

import random
from itertools import permutations

import pandas as pd
from pyspark.sql import functions as F

from quaverlake.llm import common, divergence, filter_audit, minhash

CLASHES = "mask int, key string, part string, digest string, n int, good int, first int, term string, zero long, node long, sig string, label long, band int, __n int, __h int, __key int, __text string"


def docs(spark, rows):
    """rows: (doc_id, text, lang, source), with columns that the operators use for themselves."""
    extra = [f.split(" ") for f in CLASHES.split(", ")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({n: F.lit(1).cast(t) for n, t in extra})


def words(t, low=0x09, lower=True):
    t = (t or "").encode()
    return (t.lower() if lower else t).split()


EDGES = [
    (1, None, None, None), (2, "", "en", "a"), (3, "", "en", None), (3, "", "en", "a"), (None, "", "en", "a"), (4, " \t\n", "de", "b"), (None, None, "en", "b"),
    (5, "AB c " * 60, "en", "a"), (5, "AB c " * 60, "en", "a"), (6, "AB c " * 60, None, "b"), (None, "AB c " * 60, "en", "b"), (7, "x" * 50000, "en", "a"),
    (8, " ".join(f"w{k}" for k in range(20000)), "en", "a"), (9, "é中🙂 ▁ A" * 50, "de", "b"), (10, "a | b", "de", "b"), (11, "a | b", "de", "a"),
]


# --- 11

def filters_by_hand(rows, labels):
    firsts = {}
    for k, t, *_ in rows:
        if k is not None:
            firsts[t or ""] = min(firsts.get(t or "", k), k)
    out = []
    for k, t, lang, _ in rows:
        t = t or ""
        w = words(t, lower=False)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), k is not None and k > firsts[t]]
        marks = [x for x in labels if k is not None and x[0] == k]
        out.append((lang or "", fails, any(x[1] == 1 for x in marks), any(x[2] == 1 for x in marks)))
    return out


def audit_by_hand(rows):
    found = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r[1:] for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations(range(5)):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                shapley["ABCDE"[f]] += len(gone)
                fails, alone = sum(r[0][f] for r in own), sum(r[0][f] and sum(r[0]) == 1 for r in own)
                found[part, "".join("ABCDE"[k] for k in order), step] = [len(left), len(gone), fails - len(gone), alone, sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), v in found.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return found


def audited(df, labels):
    return {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in filter_audit.audit(filter_audit.masks(df, labels)).collect()}


def test_filter_audit(spark):
    rng = random.Random(1)
    texts = [t for _, t, *_ in EDGES] + [" ".join(rng.choice(["a", "B", "cc", "D|", "word"] + [f"w{i}" for i in range(99)]) for _ in range(rng.randint(0, 300))) for _ in range(40)]
    rows = EDGES + [(rng.randint(0, 150), rng.choice(texts), rng.choice(["en", "de", None]), "s") for _ in range(200)]
    labels = [(k, rng.randint(0, 1), rng.randint(0, 1)) for k in rng.choices(range(150), k=100)] + [(None, 1, 1), (5, None, 1), (6, 1, None)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({"mask": F.lit(1), "key": F.lit("x")})
    assert audited(docs(spark, rows), marks) == audit_by_hand(filters_by_hand(rows, labels))
    assert audited(docs(spark, rows).limit(0), marks) == {}
    nobody = audited(docs(spark, EDGES), marks.limit(0))
    assert nobody == audit_by_hand(filters_by_hand(EDGES, []))


def test_filter_intervals():
    orders = list(permutations(range(4)))
    for mask in range(16):
        want = [next((s for s, f in enumerate(o) if mask >> f & 1), None) for o in orders]
        got = [None] * 24
        for step, low, high in filter_audit.intervals(mask, 4):
            assert got[low:high] == [None] * (high - low)
            got[low:high] = [step] * (high - low)
        assert got == want
    few = filter_audit.interactions(pd.DataFrame({"mask": [0, 3], "n": [5, 2], "good": [0, 1], "toxic": [0, 0]}), "XY")
    assert few["removed"].tolist() == [2, 0, 2, 0] and few["redundant"].tolist() == [0, 2, 0, 2] and few["shapley"].tolist() == [2, 2, 2, 2]


# --- 12

def divergence_by_hand(rows, least, top):
    docs_of, n_of = {}, {}
    groups = {(lang or "", source or "") for _, _, lang, source in rows}
    for _, t, lang, source in rows:
        w = divergence.terms((t or "").encode())
        for x in set(w):
            docs_of[lang or "", x] = docs_of.get((lang or "", x), 0) + 1
        for x in w:
            for s in ((source or ""), None):
                n_of[lang or "", s, x] = n_of.get((lang or "", s, x), 0) + 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [x for (k, x), n in docs_of.items() if k == lang and n >= least]
        own = [s for k, s in groups if k == lang]
        p = {}
        for s in [*own, None]:
            total = sum(n_of.get((lang, s, x), 0) for x in kept)
            p[s] = {x: 1 + 10**9 * (n_of.get((lang, s, x), 0) + 5) // (total + 5 * len(kept)) for x in kept}
        for s in own:
            pairs = sorted((-sum(abs(p[s][x] - p[o][x]) for x in kept), o.encode()) for o in own if o != s)
            best = sorted((p[None][x] - p[s][x], x) for x in kept if n_of.get((lang, s, x), 0) and p[s][x] > p[None][x])[:top]
            out += [(lang, s, "pair", i.decode(), -v, r) for r, (v, i) in enumerate(pairs, 1)] + [(lang, s, "term", i.decode(), -v, r) for r, (v, i) in enumerate(best, 1)]
    return sorted(out)


def test_divergence(spark):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "abcdé中" for b in "vwXYzß🙂"]
    rows = EDGES + [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None, "z", "a", "a"])) for k in range(150)]
    rows += [(999, "lonely", "fr", "only"), (1000, "1 2 3", "it", "a"), (1001, None, "it", "b")]
    want = divergence_by_hand(rows, 5, 7)
    for least, most in ((1, 8), (1 << 14, 1 << 21)):
        got = divergence.audit(docs(spark, rows), min_docs=5, top=7, least=least, most=most)
        assert sorted(map(tuple, got.collect())) == want
    assert ("it", "a", "pair", "b", 0, 1) in want and not any(r[0] == "fr" and r[2] == "pair" for r in want)
    assert divergence.audit(docs(spark, rows).limit(0)).collect() == []


def test_divergence_large_counts(spark):
    kept = spark.createDataFrame([(3 * 10**12, 7 * 10**12, 10)], "n long, total long, v long")
    assert kept.select(divergence.share(F.col("n"), "total")).first()[0] == 1 + 10**9 * (3 * 10**12 + 5) // (7 * 10**12 + 50)


# --- 13

def shingle_set(t):
    w = words(t)
    return frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups_by_hand(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and root[i] != root[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    out = []
    for i, (k, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        least = min(keys, default=None) if sets[i] else k
        out.append((k, len(sets[i]), least, k is not None and k == least))
    return sorted(out, key=str)


def near_copies(rng):
    """Originals with copies of every similarity around the bound, in chains too."""
    vocabulary = [f"w{k}" for k in range(3000)]
    out = []
    for g in range(12):
        text = rng.choices(vocabulary, k=rng.choice([5, 6, 9, 40, 200, 400]))
        for _ in range(14):
            copy = list(text)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy))
            if rng.random() < 0.4:
                text = copy
    return out


def test_minhash(spark):
    rng = random.Random(4)
    rows = [(k, t) for k, t, *_ in EDGES] + [(20000 - i if i % 9 else None, t) for i, t in enumerate(near_copies(rng))]
    rows += [(77, "one two three four five six"), (77, "quite another text of more words than the five"), (50, "One two  three four five six")]
    df = docs(spark, [(k, t, "en", "s") for k, t in rows])
    want = groups_by_hand(rows)
    for tile in (1024, 4):
        assert sorted(map(tuple, minhash.group(df, tile=tile).collect()), key=str) == want
    assert minhash.group(df.limit(0)).collect() == []


def test_minhash_last_links(spark):
    """Sets that the first links leave apart are found in their buckets, in any cut into tiles."""
    rng = random.Random(6)
    rows = list(enumerate(near_copies(rng)))
    df = docs(spark, [(k, t, "en", "s") for k, t in rows])
    marked = common.materialize(minhash.prints(df), "test")
    nodes = common.materialize(minhash.nodes_of(marked), "test")
    shared = common.materialize(minhash.buckets(nodes), "test")
    none = spark.createDataFrame([], "node long, component long")
    for tile in (1024, 3):
        links = minhash.last_links(shared, nodes, none, df, "doc_id", "text", tile)
        own = {r["node"]: r["component"] for r in common.connected_components(links).collect()}
        keys = {r["node"]: r["key"] for r in nodes.collect()}
        first = {own.get(n, n): min(k for m, k in keys.items() if own.get(m, m) == own.get(n, n)) for n in keys}
        want = {k: c for k, _, c, _ in groups_by_hand(rows)}
        assert {k: first[own.get(n, n)] for n, k in keys.items()} == {k: want[k] for k in keys.values()}


def test_minhash_on_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in common.read_table(spark, sf_dir, "documents").collect()]
    assert sorted(map(tuple, minhash.query(spark, sf_dir).collect()), key=str) == groups_by_hand(rows)
