"""Written intermediates, distributed union-find and small helpers that several operators use."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def workspace(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir.

    Where that is unset, a local master gets a folder of its own; on a cluster executors would each write to their
    own disk, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts the lineage.

    The files outlive lost executors and go when the JVM ends, or by dropped() before.
    """
    spark = df.sparkSession
    path = f"{workspace(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a frame from written() that nothing will read any more."""
    spark = df.sparkSession
    for name in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(name)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Distributed union-find over edges (a, b): every node of an edge with its component's least node, as (node, root).

    Alternates large-star and small-star contraction (Kiveris et al., 2014): each round only takes
    minima by node and joins them back, so hubs are pre-aggregated and AQE may split their joins.
    No edges give no rows; loops and repeated edges are harmless.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = written(pairs, "edges")
    seen = None
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        before, pairs = pairs, written(small.where("u <> v").distinct(), "star")
        dropped(before)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"union-find did not settle within {rounds} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).distinct()


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name in taken:
        name += "_"
    return name


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once even where `use` names it within a lambda."""
    return F.transform(F.array(value), use)[0]
