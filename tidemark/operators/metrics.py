"""Operational metrics over the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .offsets import KEYS, progress
from .pressure import throttles
from .running import last_known, running_sums


def snapshot(ledger: DataFrame, poll_size: int) -> DataFrame:
    """One row of counters; dead letters and skips don't count as processed."""
    got = lambda *r: F.count_if(F.col("resolution").isin(*r))
    chain = F.col("resolution").isin("SUCCESS", "DLQ_SUCCESS", "SKIP", "FAIL_PARTITION")
    counters = ledger.agg(
        got("SUCCESS").alias("records_processed"), got("FAIL_PARTITION").alias("records_failed"), got("SKIP", "HOOK_SKIP").alias("records_skipped"),
        F.coalesce(F.sum(F.when(chain, F.col("attempts") - 1)), F.lit(0)).cast("long").alias("retries"), got("DLQ_SUCCESS").alias("dlq_ok"), got("SKIP", "FAIL_PARTITION").alias("dlq_failed"),
        F.countDistinct(F.when(F.col("status") == "FAILED", F.struct(*KEYS))).alias("failed_partitions"), F.countDistinct(*KEYS).alias("assigned_partitions"),
        F.countDistinct(*KEYS, F.floor(F.col("off") / poll_size)).alias("polls"),
    )
    lags = progress(ledger).agg(F.coalesce(F.sum("lag"), F.lit(0)).cast("long").alias("total_lag"))
    return counters.withColumn("one", F.lit(1)).join(lags.withColumn("one", F.lit(1)), "one").drop("one")  # one row each


def full_snapshot(ledger: DataFrame, samples: DataFrame, commits: DataFrame, revoked: DataFrame, poll_size: int) -> DataFrame:
    """One row of all 20 fields of a run's snapshot, from what it left behind.

    ledger: with bytes; samples: (event_id, status) of the pressure; commits: (ok boolean); revoked: (topic, part, drained boolean),
    a rebalance each. A poll that brought no record of a partition is an empty one.
    """
    got = lambda *r: F.count_if(F.col("resolution").isin(*r))
    chain = F.col("resolution").isin("SUCCESS", "DLQ_SUCCESS", "SKIP", "FAIL_PARTITION")
    open_ = F.col("status") != "DONE"
    poll = F.struct(*KEYS, F.floor(F.col("off") / poll_size))
    counters = ledger.agg(
        got("SUCCESS").alias("records_processed"), got("FAIL_PARTITION").alias("records_failed"), got("SKIP", "HOOK_SKIP").alias("records_skipped"),
        F.countDistinct(poll).alias("poll_count"), (F.countDistinct(poll) - F.countDistinct(F.when(F.col("resolution") != "HELD", poll))).alias("empty_poll_count"),
        F.count_if(open_).alias("in_flight_records"), F.coalesce(F.sum(F.when(open_, F.col("bytes"))), F.lit(0)).cast("long").alias("in_flight_bytes"),
        F.coalesce(F.sum(F.when(chain, F.col("attempts") - 1)), F.lit(0)).cast("long").alias("retry_attempts"), got("DLQ_SUCCESS").alias("dlq_successes"), got("SKIP", "FAIL_PARTITION").alias("dlq_failures"),
        F.countDistinct(F.when(F.col("status") == "FAILED", F.struct(*KEYS))).alias("partition_failures"),
    )
    name = F.concat_ws("-", "topic", F.col("part").cast("string"))
    gone = revoked.select(*KEYS).distinct()
    lags = progress(ledger).join(F.broadcast(gone), KEYS, "left_anti").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat(name, F.lit("="), F.col("lag").cast("string")))), ",").alias("partition_lags"), F.array_join(F.array_sort(F.collect_list(name)), ",").alias("assigned_partitions")
    )  # a row a partition
    left = ledger.where(open_).join(F.broadcast(gone), KEYS).agg(F.count("*").alias("records_abandoned"))
    status = samples.agg(F.max_by("status", "event_id").alias("backpressure_status"))
    starts = throttles(samples, "event_id").agg(F.count("*").alias("throttle_count"))
    sent = commits.agg(F.count_if("ok").alias("commit_successes"), F.count_if(~F.col("ok")).alias("commit_failures"))
    moves = revoked.agg(F.count("*").alias("rebalance_count"), F.count_if(~F.col("drained")).alias("drain_timeouts"))
    out = counters.withColumn("one", F.lit(1))
    for one in (lags, left, status, starts, sent, moves):  # one row each
        out = out.join(one.withColumn("one", F.lit(1)), "one")
    return out.drop("one")


def rebalances(ledger: DataFrame, revoked: DataFrame) -> DataFrame:
    """(topic, part, completed, abandoned, drain_timeout) of revoked partitions: (topic, part, drained)."""
    rows = ledger.join(F.broadcast(revoked), KEYS).groupBy(*KEYS)
    return rows.agg(F.count_if(F.col("status") == "DONE").alias("completed"), F.count_if(F.col("status") != "DONE").alias("abandoned"), (~F.bool_and("drained")).alias("drain_timeout"))


def assigned(ledger: DataFrame) -> DataFrame:
    """One row: the partitions as one sorted string, and how many they are."""
    names = F.array_sort(F.collect_set(F.concat_ws("-", "topic", F.col("part").cast("string"))))
    return ledger.agg(F.array_join(names, ",").alias("partitions"), F.size(names).cast("long").alias("n"))


def rates(ledger: DataFrame, every: int) -> DataFrame:
    """Counters at every `every` events and the records a second since the snapshot before.

    Rows are summed by snapshot first; both the running sum and the snapshot before are carried by chunk, so no task sorts all snapshots.
    """
    parts = ledger.groupBy(F.floor(F.col("event_id") / every).alias("snap")).agg(F.count_if(F.col("resolution") == "SUCCESS").alias("done"), F.max(F.col("ts").cast("timestamp")).alias("at"))
    out = running_sums(parts, [], ["snap"], {"processed": F.col("done")})
    out = last_known(out, [], "snap", {"earlier": F.col("at")}, before=True)
    took = F.unix_micros("at") - F.unix_micros("earlier")
    return out.select("snap", "processed", F.when(took > 0, F.col("done") * 1_000_000.0 / took).alias("per_second"))


def average_poll(ledger: DataFrame, poll_size: int, polls_empty: int = 0) -> DataFrame:
    """Records processed for each poll that brought some; null if none did."""
    one = ledger.agg(F.count_if(F.col("resolution") == "SUCCESS").alias("processed"), F.countDistinct("topic", "part", F.floor(F.col("off") / poll_size)).alias("polls"))
    return one.select("processed", "polls", F.when(F.col("polls") > polls_empty, F.col("processed") / (F.col("polls") - polls_empty)).alias("average"))
