"""Columns of a user that have the names which operators use for themselves, and the PII operator's hidden half."""

import pytest
from pyspark.sql import functions as F

from quaverlake.llm import common, decontaminate, pii, simhash, toxicity

NAMES = "__h __base __tokens __spans __added __d __g __key __hash __n __covered __hit __items __text __score __y __row own own_key own_hash own_score body score fp root row hit_0 t o n_words contaminated".split()


@pytest.fixture(scope="module")
def table(spark):
    words = "some quite common words stand here and make a text that is long enough to be met again by all".split()
    rows = [(k, " ".join(words[k % 5 :] + [f"w{k}" for _ in range(k % 7)]) + f" mail user{k}@host{k}.example.org now") for k in range(40)]
    rows += [(50, None), (51, ""), (None, "left without a key"), (3, rows[3][1])]
    return spark.createDataFrame(rows, "doc_id long, text string")


def same(plain, clashing, columns):
    key = lambda r: tuple(str(r[c]) for c in columns)
    got = clashing.collect()
    assert sorted(map(key, plain.collect())) == sorted(map(key, got)) and got
    return got


def test_clashing_names(spark, sf_dir, table):
    odd = table.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id"), F.lit(0))) for n in NAMES})
    kept = lambda r: all(r[n] == f"{n}{r['doc_id'] or 0}" for n in NAMES)
    benchmark = spark.createDataFrame([("a", "some quite common words stand here and make a text that is long")], "item_id string, text string").withColumns({n: F.lit(1) for n in NAMES})
    labels = spark.createDataFrame([(k, int(k == 39)) for k in range(40)], "doc_id long, toxic int").withColumns({n: F.lit(1) for n in NAMES if n != "t"})
    for run in (pii.redact, simhash.keep_first, lambda d: decontaminate.remove_documents(d, benchmark), lambda d: decontaminate.remove_spans(d, benchmark), lambda d: toxicity.drop_toxic(d, d, labels)):
        got = run(odd)
        assert got.columns == odd.columns
        assert all(map(kept, same(run(table), got, ["doc_id", "text"])))
    judged = decontaminate.judge(odd, benchmark)
    assert [c for c in judged.columns if c not in ("n_hit", "n_items", "items")] == [c for c in odd.columns if c not in ("n_words", "contaminated")] + ["n_words", "contaminated"]
    same(decontaminate.judge(table, benchmark), judged, ["doc_id", "text", "n_words", "n_hit", "n_items", "items", "contaminated"])


@pytest.mark.parametrize(("size", "least"), [("sf0.01", 0.4), ("sf0.1", 0.8)])
def test_pii_finds_a_hidden_half(spark, size, least):
    """Half of the base identifiers aren't known to learn(); most are found again, and next to nothing else."""
    got = pii.held_back(common.read_table(spark, f"/root/testdata/{size}", "documents")).collect()
    hidden, found, wrong = (sum(r[c] for r in got) for c in ("n_hidden", "n_found", "n_wrong"))
    assert hidden > 20 and found / hidden >= least and found / (found + wrong) >= 0.9


def test_pii_counts_seeds_apart(spark):
    token = lambda k: f"{k * 7919 + 13:032x}"[:31] + "a"
    rows = [(k, f'set token = "{token(k)}" here') for k in range(30)] + [(100, 'set token = "QWERTY12345678901234ABCD" here')]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k]["n_seeded"] == len(got[k]["spans"]) - len(got[k]["base"]) == 1 for k in range(30))
    assert got[100]["n_seeded"] == 0 and [s["kind"] for s in got[100]["spans"]] == ["secret"]
