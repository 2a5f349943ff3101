"""Registered queries over the events table: one for each operator of the log's lifecycle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Backoff, ErrorPolicy, Fallback, PipelineConfig, Thresholds
from ..functions import scalars
from ..operators import errors, metrics, offsets, pressure
from ..operators.running import numbered
from ..streaming.runtime import run_record
from . import log as plans

KEYS = ["topic", "part"]
POLL = 500
RECORDS, BYTES, RATIO = Thresholds(60, 100, 500), Thresholds(100, 200, 400), Thresholds(0.5, 0.7, 0.9)
Query = Callable[[SparkSession, str], DataFrame]


def _partitions(spark: SparkSession, *parts: int) -> DataFrame:
    return spark.createDataFrame([("events", p) for p in parts], "topic string, part int")


def partitioned_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.partitioned_log(spark, sf_dir).select(*KEYS, "off", "k", "v", "event_id")


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plans.partitioned_log(spark, sf_dir).withColumn("bytes", scalars.record_bytes(F.col("k"), F.col("v")))
    by = F.floor(F.col("off") / POLL).alias("poll_id")
    return rows.groupBy(*KEYS, by).agg(F.min("off").alias("first_off"), F.max("off").alias("last_off"), F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def register_batch_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offsets.expand_batches(_batches(spark, sf_dir)).select(*KEYS, "poll_id", "off")


def partition_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each record's offset is its rank by arrival, and the partition's ends."""
    rows = numbered(plans.partitioned_log(spark, sf_dir), KEYS, "event_id", "rank")
    return rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("off").alias("first_off"), F.max("off").alias("last_off"), F.count_if(F.col("off") != F.col("rank")).alias("out_of_order"))


def record_handler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A per-record Python handler: the length of the value and the partition, added up."""

    def handle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(handled=b["v"].str.len().fillna(0).astype("int64") + b["part"])[[*KEYS, "off", "handled"]]

    return plans.partitioned_log(spark, sf_dir).select(*KEYS, "off", "v").mapInPandas(handle, "topic string, part int, off long, handled long")


def batch_handler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python handler of whole polls."""

    def handle(b: pd.DataFrame) -> pd.DataFrame:
        first = b.iloc[0]
        return pd.DataFrame([{"topic": first["topic"], "part": first["part"], "poll_id": first["poll_id"], "n": len(b), "failing": int((b["fail_until"] > 0).sum())}])

    rows = plans.partitioned_log(spark, sf_dir).select(*KEYS, F.floor(F.col("off") / POLL).alias("poll_id"), "fail_until")
    return rows.groupBy(*KEYS, "poll_id").applyInPandas(handle, "topic string, part int, poll_id long, n long, failing long")


def record_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runtime's own record loop, hooks and error chain included, over records that fail as the log says."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for skips in (True, False):  # partition 3 halts on failure, here one record at a time
                rows = list(b[(b["part"] != 3) == skips].itertuples(index=False, name="Record"))
                tried: dict = {}

                def handle(r, tried=tried) -> None:
                    tried[r.event_id] = tried.get(r.event_id, 0) + 1
                    if tried[r.event_id] <= r.fail_until:
                        raise ValueError(r.event_id)

                def bury(r, error: str) -> None:
                    if r.dlq_broken:
                        raise OSError(error)

                errors_ = ErrorPolicy(max_retries=plans.MAX_RETRIES, base_ms=0, dead_letter=bury, fallback=Fallback.SKIP if skips else Fallback.FAIL_PARTITION)
                config = PipelineConfig(("events",), handle, before=lambda r: r.event_id % 50 != 7, errors=errors_)
                out += [(r.topic, r.part, r.off, *run_record(config, r)[:2]) for r in rows]
            yield pd.DataFrame(out, columns=[*KEYS, "off", "resolution", "attempts"])

    rows = plans.partitioned_log(spark, sf_dir).select(*KEYS, "off", "fail_until", "dlq_broken", "event_id")
    return rows.mapInPandas(run, "topic string, part int, off long, resolution string, attempts int")


def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolve = lambda fails, broken, part: plans.resolution(fails, broken, part != 3)
    return errors.batch_outcomes(plans.partitioned_log(spark, sf_dir), 5, resolve, lambda fails: plans.attempts(fails))


def hook_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.partitioned_log(spark, sf_dir).where(plans.hooked()).select(*KEYS, "off")


def dedup_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that the store of handled ids doesn't hold."""
    rows = plans.partitioned_log(spark, sf_dir)
    store = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 3 = 0").select("event_id")
    return rows.join(store, "event_id", "left_anti").select(*KEYS, "off", "event_id")


def _registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations of the log, of which every 97th event comes again later."""
    rows = plans.partitioned_log(spark, sf_dir).select(*KEYS, "off", "event_id")
    again = rows.where("event_id % 97 = 0").withColumn("seq", F.col("event_id") * 2 + 5)
    return rows.withColumn("seq", F.col("event_id") * 2).unionByName(again)


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes: every 101st record is acked without having been started, every 89th one is registered twice."""
    rows = plans.events_ledger(spark, sf_dir).where("resolution <> 'HELD'")
    end = F.when(F.col("status") == "FAILED", "FAILED").otherwise("DONE")
    steps = F.when(F.col("event_id") % 101 == 0, F.array(F.lit("REGISTERED"), end)).when(F.col("event_id") % 89 == 0, F.array(F.lit("REGISTERED"), F.lit("REGISTERED"), F.lit("IN_PROGRESS"), end)).otherwise(F.array(F.lit("REGISTERED"), F.lit("IN_PROGRESS"), end))
    return rows.select(*KEYS, "off", F.posexplode(steps).alias("seq", "status"))


def _range_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations of polls of 50: every 7th comes again, every 11th has its ends swapped, every 13th comes again one further on."""
    rows = plans.partitioned_log(spark, sf_dir).groupBy(*KEYS, F.floor(F.col("off") / 50).alias("n")).agg(F.min("off").alias("first_off"), F.max("off").alias("last_off"))
    swapped = F.col("n") % 11 == 5
    plain = rows.select(*KEYS, (F.col("n") * 4).alias("seq"), F.when(swapped, F.col("last_off") + 1).otherwise(F.col("first_off")).alias("first_off"), F.when(swapped, F.col("first_off")).otherwise(F.col("last_off")).alias("last_off"))
    again = rows.where("n % 7 = 3").select(*KEYS, (F.col("n") * 4 + 1).alias("seq"), "first_off", "last_off")
    late = rows.where("n % 13 = 6").select(*KEYS, (F.col("n") * 4 + 2).alias("seq"), (F.col("first_off") + 1).alias("first_off"), (F.col("last_off") + 1).alias("last_off"))
    return plain.unionByName(again).unionByName(late)


def batch_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of ten are started, then every second one is acked: the partitions' counts and what they can commit."""
    log = plans.partitioned_log(spark, sf_dir).select(*KEYS, "off").withColumn("status", F.lit("REGISTERED"))
    ranges = log.groupBy(*KEYS, F.floor(F.col("off") / 10).alias("n")).agg(F.min("off").alias("first_off"), F.max("off").alias("last_off"))
    started = offsets.mark_ranges(log, ranges.where("n % 5 <> 4"), "REGISTERED", "IN_PROGRESS")
    acked = offsets.mark_ranges(started, ranges.where("n < 20 or n % 2 = 0"), "IN_PROGRESS", "DONE")
    return offsets.partition_counts(acked).join(offsets.committable(acked), KEYS)


def init_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = spark.createDataFrame([("events", 0, 0), ("events", 1, 100), ("events", 3, 10**9), ("events", 9, 5)], "topic string, part int, base long")
    return offsets.based(plans.events_ledger(spark, sf_dir), starts).withColumn("committable", F.coalesce("committable", F.lit(-1).cast("long")))


def _revoked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("events", 1, True), ("events", 3, False)], "topic string, part int, drained boolean")


def full_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = plans.events_ledger(spark, sf_dir).withColumn("bytes", scalars.record_bytes(F.col("k"), F.col("v")))
    commits = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 500 = 0").select((F.col("event_id") % 7 != 0).alias("ok"))
    return metrics.full_snapshot(ledger, _sensed(spark, sf_dir).select("event_id", "status"), commits, _revoked(spark), POLL)


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.outcomes(plans.partitioned_log(spark, sf_dir))


def retry_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outcomes(spark, sf_dir).where("resolution <> 'HOOK_SKIP'")
    return rows.select(*KEYS, "off", "attempts", (F.col("resolution") == "SUCCESS").alias("success"))


def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = {"fixed": ErrorPolicy(base_ms=100), "free": ErrorPolicy(base_ms=100, backoff=Backoff.EXPONENTIAL, max_ms=0), "capped": ErrorPolicy(base_ms=100, backoff=Backoff.EXPONENTIAL, max_ms=500), "zero": ErrorPolicy(base_ms=0, backoff=Backoff.EXPONENTIAL)}
    attempt = spark.range(-1, 51).select(F.col("id").cast("int").alias("attempt"))
    return attempt.select("attempt", *(scalars.backoff_ms(F.col("attempt"), p).alias(f"{n}_ms") for n, p in policies.items()))


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record enters at 2 * event_id and leaves five steps later."""
    rows = plans.partitioned_log(spark, sf_dir).select("event_id", scalars.record_bytes(F.col("k"), F.col("v")).alias("bytes"))
    enter = rows.select((F.col("event_id") * 2).alias("seq"), F.lit(1).cast("long").alias("records"), "bytes")
    leave = rows.select((F.col("event_id") * 2 + 5).alias("seq"), F.lit(-1).cast("long").alias("records"), (-F.col("bytes")).alias("bytes"))
    return enter.unionByName(leave)


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return e.select("event_id", (F.col("event_id") * 37 % 600).alias("records"), (F.col("event_id") * 7919 % 500).alias("bytes"), (F.col("event_id") * 31 % 100 / 100.0).alias("ratio"))


def _sensor(value: str, limits: Thresholds) -> Query:
    return lambda spark, sf_dir: pressure.sensor(_samples(spark, sf_dir), "event_id", value, limits).select("event_id", value, "status")


def _sensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _samples(spark, sf_dir)
    for value, limits in (("records", RECORDS), ("bytes", BYTES), ("ratio", RATIO)):
        out = pressure.sensor(out, "event_id", value, limits, f"{value}_status")
    return out.withColumn("status", pressure.worst(F.col("records_status"), F.col("bytes_status"), F.col("ratio_status")))


def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = {
        "records": pressure.count_detail(F.col("records"), RECORDS, F.col("records_status")),
        "bytes": pressure.bytes_detail(F.col("bytes"), BYTES, F.col("bytes_status")),
        "heap": pressure.ratio_detail(F.col("ratio"), RATIO, F.col("ratio_status")),
    }
    return _sensed(spark, sf_dir).select("event_id", pressure.summary(details).alias("summary"))


def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") * F.col("event_id") * 7919
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", n.alias("n"), scalars.format_bytes(n).alias("text"))


def record_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.partitioned_log(spark, sf_dir).select(*KEYS, "off", scalars.record_bytes(F.col("k"), F.col("v")).alias("bytes"))


def _ledger(rule: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rule(plans.events_ledger(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "partitioned_log_scan": partitioned_log_scan,
    "poll_batches": _batches,
    "partition_fifo": partition_fifo,
    "queue_depth": _ledger(offsets.queue_depth),
    "retain_partitions": lambda s, d: offsets.retained(partitioned_log_scan(s, d), _partitions(s, 0, 2)),
    "abandoned_records": lambda s, d: offsets.abandoned(plans.events_ledger(s, d), _partitions(s, 1, 3)),
    "record_handler": record_handler,
    "batch_handler": batch_handler,
    "record_outcomes": record_outcomes,
    "batch_outcomes": batch_outcomes,
    "hook_skip": hook_skip,
    "dedup_anti": dedup_anti,
    "register_violations": lambda s, d: offsets.register_violations(_registrations(s, d)),
    "order_violations": lambda s, d: offsets.order_violations(_registrations(s, d)),
    "register_batch_expand": register_batch_expand,
    "illegal_transitions": lambda s, d: offsets.illegal_transitions(_changes(s, d)),
    "latest_status": lambda s, d: offsets.latest_status(_changes(s, d)),
    "failed_partitions": _ledger(offsets.failed_partitions),
    "held_records": _ledger(offsets.held_records),
    "resolve_failure": _ledger(offsets.resolved_committable),
    "register_batches": lambda s, d: offsets.register_batches(_range_batches(s, d)),
    "batch_marks": batch_marks,
    "init_partitions": init_partitions,
    "clear_partitions": lambda s, d: offsets.partition_counts(offsets.cleared(plans.events_ledger(s, d), _partitions(s, 1, 3))),
    "rebalances": lambda s, d: metrics.rebalances(plans.events_ledger(s, d), _revoked(s)),
    "full_metrics": full_metrics,
    "committable_offset": _ledger(offsets.progress),
    "commit_map": _ledger(offsets.commit_map),
    "drain_result": _ledger(offsets.drain_result),
    "partition_counts": _ledger(offsets.partition_counts),
    "partition_lag": _ledger(lambda x: offsets.progress(x).select(*KEYS, "lag")),
    "window_occupancy": _ledger(offsets.window_occupancy),
    "retry_outcomes": retry_outcomes,
    "retry_counts": lambda s, d: errors.retries(_outcomes(s, d)),
    "backoff_schedule": backoff_schedule,
    "error_attempts": lambda s, d: errors.error_attempts(_outcomes(s, d)),
    "dlq_records": _ledger(errors.dead_letters),
    "skipped_records": _ledger(errors.skipped),
    "in_flight": lambda s, d: pressure.in_flight(_deltas(s, d), ["seq", "records"]).select("seq", "records", "in_flight", "in_flight_bytes"),
    "record_count_sensor": _sensor("records", RECORDS),
    "byte_size_sensor": _sensor("bytes", BYTES),
    "ratio_sensor": _sensor("ratio", RATIO),
    "worst_status": lambda s, d: _sensed(s, d).select("event_id", "status"),
    "status_summary": status_summary,
    "throttle_transitions": lambda s, d: pressure.throttles(_sensed(s, d), "event_id").select("event_id", "status"),
    "metrics_snapshot": _ledger(lambda x: metrics.snapshot(x, POLL)),
    "assigned_partitions": _ledger(metrics.assigned),
    "metrics_rate": _ledger(lambda x: metrics.rates(x, 1_000)),
    "avg_poll_size": _ledger(lambda x: metrics.average_poll(x, POLL)),
    "record_bytes": record_bytes,
    "format_bytes": format_bytes,
}
