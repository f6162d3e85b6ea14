"""Streams with late samples give the rows of the table, however they are cut and shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from quaverlake.streaming import Changes, Easing, Polls, Speech, over_late_stream, over_table

STORE = "spark.sql.streaming.stateStore.providerClass"


def streamed(spark, tmp_path, rows, schema, machine, seed, delay):
    """Rows in shuffled order, in files of any size; each is at most `delay` behind. A last file of another key moves the watermark on."""
    rng = random.Random(seed)
    late = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 9_000))
    n = 0
    while late:
        k = rng.randint(1, len(late))
        spark.createDataFrame(late[:k], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n:03d}"))
        late, n = late[k:], n + 1
    end = [(99, 10**9, *rows[0][2:])]
    spark.createDataFrame(end, schema).coalesce(1).write.parquet(str(tmp_path / "in" / "end"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
    name = f"late_{type(machine).__name__}_{seed}"
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = over_late_stream(stream, machine, "k", delay).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
    finally:
        spark.conf.set(STORE, before)
    return sorted(map(str, spark.table(name).where("k <> 99").collect()))


@pytest.mark.parametrize(("machine", "seed"), [(Changes(), 1), (Polls(), 2), (Speech(64), 3), (Easing(), 4)])
def test_late_samples(spark, tmp_path, machine, seed):
    r = random.Random(seed)
    rows = [(k, 1_000_000 + i * 250 + r.randint(0, 40), i, r.choice(["a", "a", "b", None]), r.choice(["x", "y"]), r.random() < 0.1, r.random(), r.random() * 0.2 + 0.8 * (i // 20 % 2), r.random()) for i in range(120) for k in (1, 2, 3)]
    schema = "k long, t long, id long, item string, title string, failed boolean, rise double, p double, imminence double"
    df = spark.createDataFrame(rows, schema).withColumn("app", F.col("item"))
    want = sorted(map(str, over_table(df, machine, "k").collect()))
    rows = [(*x, x[3]) for x in rows]
    assert streamed(spark, tmp_path, rows, schema + ", app string", machine, seed, "10 seconds") == want and want
