"""The canonical partitioned log over the events table, and the ledger of its processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import numbered

MAX_RETRIES = 3
PARTITIONS = 4


def partitioned_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in the partition user_id % 4; offsets count from 0 by event_id."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    part = (F.col("user_id") % PARTITIONS).cast("int")
    rows = events.select(
        F.lit("events").alias("topic"), part.alias("part"), F.col("user_id").cast("string").alias("k"), F.col("props").alias("v"), "ts", "event_id", "event_type", "value",
        F.when(F.col("event_type") == "error", (F.col("event_id") % 6).cast("int")).otherwise(0).alias("fail_until"),
        F.when(F.col("event_id") % 4 == 0, 1).otherwise(0).alias("dlq_broken"),
    )
    return numbered(rows, ["topic", "part"], "event_id", "off")


def hooked() -> Column:
    return F.col("event_id") % 50 == 7


def resolution(fail_until: Column, dlq_broken: Column, skips: Column, hook: Column | None = None, retries: int = MAX_RETRIES) -> Column:
    """What the error chain makes of a record that fails its first fail_until attempts."""
    chain = F.when(fail_until <= retries, "SUCCESS").when(dlq_broken == 0, "DLQ_SUCCESS").when(skips, "SKIP").otherwise("FAIL_PARTITION")
    return chain if hook is None else F.when(hook, "HOOK_SKIP").otherwise(chain)


def attempts(fail_until: Column, hook: Column | None = None, retries: int = MAX_RETRIES) -> Column:
    n = F.least(fail_until, F.lit(retries)) + 1
    return n if hook is None else F.when(hook, 0).otherwise(n)


def outcomes(log: DataFrame) -> DataFrame:
    """log with resolution and attempts: partition 3 halts on failure, the others skip."""
    skips = F.col("part") != 3
    return log.withColumns({"resolution": resolution(F.col("fail_until"), F.col("dlq_broken"), skips, hooked()), "attempts": attempts(F.col("fail_until"), hooked())})


def ledger(log: DataFrame) -> DataFrame:
    """outcomes with status: past a partition's first failure records are held back, so they stay REGISTERED.

    The first failure is a minimum by partition, so no window runs over a whole partition.
    """
    rows = outcomes(log)
    failed = rows.groupBy("topic", "part").agg(F.min(F.when(F.col("resolution") == "FAIL_PARTITION", F.col("off"))).alias("first_failed"))
    held = F.col("off") > F.col("first_failed")
    rows = rows.join(failed, ["topic", "part"])
    status = F.when(held, "REGISTERED").when(F.col("resolution") == "FAIL_PARTITION", "FAILED").otherwise("DONE")
    return rows.withColumns({"status": status, "would_fail": F.col("resolution") == "FAIL_PARTITION", "resolution": F.when(held, "HELD").otherwise(F.col("resolution"))}).drop("first_failed")


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(partitioned_log(spark, sf_dir))
