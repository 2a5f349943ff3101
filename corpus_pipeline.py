"""A corpus pipeline of five stages; each is one operator of tidemark.llm at its production parameters.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns the
columns of documents; the last one adds size, shard and slot.

All stages: an empty table gives no rows; further columns of documents pass through, whatever their names; a document
is an id and a text, so null and repeated ids with different texts are documents of their own; a very long text is
worked on whole, in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, jaccard, mixing, quality, sharding
from tidemark.llm.shared import documents, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of bad quality and toxic ones.

    Null, empty and wordless texts are rejected; repeated rows and ties of score are judged alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return quality.classify(docs, labels).where("keep").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least document of each group of near duplicates: the least id, then the least hash of the text.

    Repeated rows are one document, of which one row stays; null and wordless texts are near nothing.
    """
    return jaccard.keep_one(docs).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a passage of the benchmark.

    Null and wordless texts hold none; repeated rows are judged alike.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, items).where("n_hit = 0").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks, in training order.

    Null sources are one source, the last; texts without words have size 0; ties of position go by id.
    """
    return mixing.expanded(mixing.mix(docs), docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the mix to shards of near equal bytes.

    Null texts count one byte; equal texts are neighbours; repeated rows are rows of their own with slots of their own.
    """
    return sharding.shard(docs)


STAGES = [("quality", classify), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixing", mix), ("sharding", shard)]

#: Trained weights and connected components are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
