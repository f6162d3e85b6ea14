"""Values that most rows share, and tables that are cut into files otherwise, change no result."""

import random

import numpy as np
from pyspark.sql import functions as F

from quaverlake.llm import common, packing, sharding, simhash, warc


def test_packing_is_free_of_files(spark):
    docs = common.read_table(spark, "/root/testdata/sf0.001", "documents")
    found = [{tuple(map(str, r)) for r in packing.pack(docs.repartition(n), row=256, window_tokens=30_000, encoder=packing.byte_pairs(), end=packing.RANKS_END, pad=packing.RANKS_PAD).collect()} for n in (1, 5)]
    assert found[0] == found[1] and len({r[0].split("-")[0] for r in map(list, found[0])}) > 3


def test_packed_ids_are_the_tokenizers(spark):
    texts = ["Zwei Wörter, 3 numbers  and\n\nspaces", "", None, "é中🙂" * 400]
    packs = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), row=64, encoder=packing.byte_pairs(), end=packing.RANKS_END, pad=packing.RANKS_PAD).collect()
    parts = {}
    for r in packs:
        for d, at, ids in packing.unpack(r, length=64)[1]:
            parts.setdefault(d, []).append((at, ids))
    coder = packing._coder(packing.RANKS, packing.PIECES)
    for d, t in enumerate(texts):
        whole = np.concatenate([ids for _, ids in sorted(parts[d], key=lambda x: x[0])]).tolist()
        assert whole == [*coder.encode_ordinary(t or ""), packing.RANKS_END] and coder.decode(whole[:-1]) == (t or "")


def test_sharding_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 7)
    rows = [(1, "same")] * 50 + [(k, f"t{k}") for k in range(2, 60)] + [(None, None)] * 9
    got = sharding.shard_manifest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for s in {r["shard"] for r in got}:
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    assert sharding.shard_manifest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_popular_payload(spark):
    same, other = b"x" * 200, b"y" * 200
    rows = [(str(k), f"http://a/{k}", "1.1.1.1", "20200101000000", b"HTTP/1.1 200 OK\r\n\r\n", same if k % 10 else other) for k in range(400)] + [(None, "http://a/n", "1.1.1.1", "20200101000000", b"", same)]
    records = spark.createDataFrame(rows, "key string, url string, ip string, date string, head binary, payload binary").repartition(3)
    heads = [next(warc.read_warc(bytes(r["record"]) + b"\r\n\r\n"))[0] for r in warc.to_warc(records).collect()]
    kinds = [h["WARC-Type"] for h in heads]
    assert len(heads) == 401 and kinds.count("response") == 2
    assert {h["X-Refers-To-Key"] for h in heads if h["WARC-Type"] == "revisit"} == {"0", "1"}


def test_simhash_of_a_shared_value(spark, monkeypatch):
    """Fingerprints that nearly all share a partition's value; probes come in many pieces and the forest is forgotten on the way."""
    monkeypatch.setattr(simhash, "HELD", 50)
    monkeypatch.setattr(simhash, "FOREST", 5)
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(20)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f, f) for f in signed], "fp long, rep long")
    own = {r["node"]: r["component"] for r in common.connected_components(simhash.links(df, 4, tile=64)).collect()}
    root = {f: f for f in signed}
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if root[a] != root[b] and ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert {f: own.get(f, f) for f in signed} == root
