"""The error chain: retries, dead letters, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .offsets import KEYS


def error_attempts(outcomes: DataFrame) -> DataFrame:
    """One row for each failed attempt, numbered from 0."""
    failed = F.when(F.col("resolution").isin("HOOK_SKIP", "HELD"), 0).when(F.col("resolution") == "SUCCESS", F.col("attempts") - 1).otherwise(F.col("attempts"))
    rows = outcomes.where(failed > 0)
    return rows.select(*KEYS, "off", F.explode(F.sequence(F.lit(0), failed - 1)).alias("attempt"))


def retries(outcomes: DataFrame) -> DataFrame:
    """(topic, part, retries): failed attempts that another one followed."""
    again = F.when(F.col("attempts") > 0, F.col("attempts") - 1).otherwise(0)
    return outcomes.where("resolution <> 'HELD'").groupBy(*KEYS).agg(F.sum(again).cast("long").alias("retries"))


def last_error(attempts: Column) -> Column:
    return F.format_string("attempt %d failed", attempts)


def dead_letters(ledger: DataFrame) -> DataFrame:
    return ledger.where("resolution = 'DLQ_SUCCESS'").select(*KEYS, "off", "k", "v", "attempts", last_error(F.col("attempts")).alias("last_error"))


def skipped(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("resolution").isin("SKIP", "HOOK_SKIP")).select(*KEYS, "off", "resolution")


def batch_outcomes(log: DataFrame, size: int, resolve, attempts) -> DataFrame:
    """All or nothing by partition batch: the worst record decides for all.

    Of a batch that fails its partition only the first offset counts as failed.
    """
    batch = F.floor(F.col("off") / size).alias("poll_id")
    rows = log.groupBy(*KEYS, batch).agg(F.min("off").alias("first_off"), F.max("off").alias("last_off"), F.count("*").alias("n"), F.max("fail_until").alias("fail_until"), F.max("dlq_broken").alias("dlq_broken"))
    out = rows.withColumns({"resolution": resolve(F.col("fail_until"), F.col("dlq_broken"), F.col("part")), "attempts": attempts(F.col("fail_until"))})
    failed = F.when(F.col("resolution") == "FAIL_PARTITION", F.col("first_off"))
    return out.select(*KEYS, "poll_id", "first_off", "last_off", "n", "resolution", "attempts", failed.alias("failed_off"))
