"""The thin queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, lines, mixing, quality, secrets, sharding, substrings, tokens, topk
from .shared import documents


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return tokens.token_counts(docs, tokens.TokenCounts(tokenizer_path())).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.duplicate_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk.top_k(rows, rows.where("vec_id % 20 = 0"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = [r.kind for r in secrets.RULES if r.base]
    kept = secrets.written_spans(F.filter("found", lambda x: x["kind"].isin(base)))
    return out.select("doc_id", *map(count, base), F.sha2(kept, 256).alias("base_sha256"), "spans")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    kept = mixed.select("doc_id", "size", "source_size", "target", "taken", "positions")
    return mixing.ordered(kept).select("doc_id", "size", "source_size", "target", "taken", "position")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate.decontaminate(documents(spark, sf_dir).select("doc_id", "text"), bench)
    items = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return quality.classify(documents(spark, sf_dir).select("doc_id", "text"), labels).select("doc_id", "quality", "toxicity", "keep")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    # Taken before rows move, so that the texts needn't.
    out = sharding.shard(documents(spark, sf_dir).select("doc_id", "text", crc.alias("text_crc32")))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_topk_search": op2_topk_search,
    "op3_token_counts": op3_token_counts,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_secret_scan": op5_secret_scan,
    "op6_mixing": op6_mixing,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_sharding": op10_sharding,
}
