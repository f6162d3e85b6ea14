"""What the operators of this subpackage share: tables, durable intermediates, labels of linked nodes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A local session without one (a test) gets a temporary folder; on a cluster that is an error."""
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quaverlake-")
        spark.conf.set(CHECKPOINT_KEY, path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_OWNERS: list[list[DataFrame]] = []


@contextmanager
def owned() -> Iterator[None]:
    """Deletes on leaving what materialize() wrote inside; results must have been written or collected by then."""
    _OWNERS.append([])
    try:
        yield
    finally:
        for df in _OWNERS.pop():
            discard(df)


def materialize(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lost executors lose nothing, and the reader knows its size.

    The innermost owned() deletes the table unless it is `kept`; without one, whoever owns the shared folder does.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quaverlake_path = path
    if _OWNERS and not kept:
        _OWNERS[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any longer."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._quaverlake_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


ROW = "__row"


def packed(df: DataFrame, without: str | None = None, **named: Column) -> DataFrame:
    """All columns of df (but one) inside the struct ROW, and the named ones beside it: no name of df can clash with an operator's own."""
    own = [F.col(f"`{c}`") for c in df.columns if c != without]
    return df.select((F.struct(*own) if own else F.lit(None).cast("struct<>")).alias(ROW), *[c.alias(n) for n, c in named.items()])


def unpacked(df: DataFrame, columns: list[str], **instead: Column) -> DataFrame:
    """The columns of packed() again, those of `instead` from elsewhere."""
    return df.select(*[instead[c].alias(c) if c in instead else F.col(ROW).getField(c).alias(c) for c in columns])


def null_safe_text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> (node, component): the smallest node that each node reaches.

    Alternates large-star and small-star steps (Kiveris et al. 2014). Each round keeps at
    most as many edges as the one before and is written to the shared folder, so that the
    plan stays short. Nodes without an edge aren't returned. Self loops and nulls are left out.
    """
    now = materialize(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    state = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        )
        after = materialize(small.select("e.*").where("u <> v").distinct(), "links")
        discard(now)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
