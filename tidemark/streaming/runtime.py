"""The streaming runtime: handlers under the error chain, a ledger, dead letters, commits and admission control.

Each micro-batch is handled once, inside tasks: one task for each log partition, records in offset order,
`concurrency` of them at a time. The outcome rows are written to the ledger under the batch's id,
overwriting what an earlier try of that batch left, and the compacted state goes on by them (see state.py).
Delivery is at least once: a retried task or batch runs its handlers again.

A record whose policy is to fail its partition is FAILED; the later ones of the partition are HELD,
not handled, in this batch and all later ones, until resolve() marks it as DONE. Held records are
then handled by replay().

A supervisor thread starts the query, and starts it anew from its checkpoint when it fails. Partitions are
assigned as they appear; revoke() takes some away in the order abandon, drain, commit, clear, and assign() gives
them back at a position. Stopping lets the running batch end, commits and then ends the threads.
"""

from __future__ import annotations

import atexit
import logging
import os
import signal
import threading
import time
from collections.abc import Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Fallback, PipelineConfig, ThreadMode
from ..functions.scalars import record_bytes
from ..operators import offsets
from ..schema import LEDGER_SCHEMA
from .counters import Counters, Muted, PipelineMetrics
from .sensors import Controller, byte_sensor, heap_ratio, heap_sensor, record_sensor
from .state import COUNTERS, Store, advanced

log = logging.getLogger(__name__)
KEYS = ["topic", "part"]
_COLUMNS = ["topic", "part", "off", "k", "v", "bytes", "batch_id", "status", "resolution", "attempts", "last_error"]
Partition = tuple[str, int]


def _tried(config: PipelineConfig, call, on_error=None) -> tuple[int, str | None]:
    """(attempts, last error or None)."""
    for attempt in range(config.errors.max_retries + 1):
        if attempt:
            time.sleep(config.errors.delay_ms(attempt) / 1000)
        try:
            call()
            return attempt + 1, None
        except Exception as e:
            error = e
            if on_error is not None:
                try:
                    on_error(attempt, e)
                except Exception:  # a hook's failure must not hide the handler's
                    pass
    return config.errors.max_retries + 1, f"{type(error).__name__}: {error}"


def _resolved(config: PipelineConfig, records: list, error: str) -> str:
    """What becomes of records that failed for good. Letters sent before one fails stay sent."""
    if config.errors.dead_letter is not None:
        try:
            for r in records:
                config.errors.dead_letter(r, error)
            return "DLQ_SUCCESS"
        except Exception:
            pass
    return "SKIP" if config.errors.fallback is Fallback.SKIP else "FAIL_PARTITION"


def run_record(config: PipelineConfig, record) -> tuple[str, int, str | None]:
    """(resolution, attempts, error) of one record: hook, handler under the error chain, fallback."""
    if config.before is not None:
        try:
            if not config.before(record):
                return "HOOK_SKIP", 0, None
        except Exception:  # then the record is handled
            pass

    def call() -> None:
        config.handler(record)
        if config.after is not None:
            config.after(record)

    hook = None if config.on_error is None else lambda attempt, e: config.on_error(record, attempt, e)
    tried, error = _tried(config, call, hook)
    return ("SUCCESS" if error is None else _resolved(config, [record], error)), tried, error


def _polls(config: PipelineConfig, records: list) -> Iterator[list]:
    for i in range(0, len(records), config.batch_limit):
        yield records[i : i + config.batch_limit]


def _batches(config: PipelineConfig, records: list) -> list:
    """A batch handler's polls one after the other; all or nothing each, and none after one that failed its partition."""
    out: list = []
    for poll in _polls(config, records):
        if out and out[-1][1] in ("FAIL_PARTITION", "HELD"):
            out += [("REGISTERED", "HELD", 0, None)] * len(poll)
            continue
        tried, error = _tried(config, lambda: config.batch_handler(poll[0].topic, poll[0].part, poll))  # noqa: B023
        how = "SUCCESS" if error is None else _resolved(config, poll, error)
        if how == "FAIL_PARTITION":
            out += [("FAILED", how, tried, error)] + [("REGISTERED", "HELD", 0, None)] * (len(poll) - 1)
            return out + [("REGISTERED", "HELD", 0, None)] * (len(records) - len(out))
        out += [("DONE", how, tried, error)] * len(poll)
    return out


def handle_partition(config: PipelineConfig, records: list) -> list[tuple[str, str, int, str | None]]:
    """(status, resolution, attempts, error) of one partition's records in offset order."""
    if config.batch_handler is not None:
        return _batches(config, records)
    most = config.batch_limit if config.threads is ThreadMode.VIRTUAL else config.concurrency
    out: list = [("REGISTERED", "HELD", 0, None)] * len(records)
    with ThreadPoolExecutor(min(most, max(len(records), 1))) as pool:
        running, nth, failed = {}, 0, False
        while running or (nth < len(records) and not failed):
            # As one ends the next begins. What runs beside a failure may still finish; nothing is begun after it.
            while nth < len(records) and len(running) < most and not failed:
                running[pool.submit(run_record, config, records[nth])] = nth
                nth += 1
            for done in wait(running, return_when=FIRST_COMPLETED).done:
                how, tried, error = done.result()
                out[running.pop(done)] = ("FAILED" if how == "FAIL_PARTITION" else "DONE", how, tried, error)
                failed = failed or how == "FAIL_PARTITION"
    return out


def outcomes(batch: DataFrame, config: PipelineConfig, blocked: DataFrame, batch_id: int) -> DataFrame:
    """Ledger rows of a batch. blocked: (topic, part) of failed partitions, whose records are held."""
    rows = batch.join(F.broadcast(blocked.withColumn("blocked", F.lit(True))), KEYS, "left").withColumn("bytes", record_bytes(F.col("k"), F.col("v")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("off").drop_duplicates("off")
        records = list(pdf[["topic", "part", "off", "k", "v"]].itertuples(index=False, name="Record"))
        held = bool(pdf["blocked"].fillna(False).iloc[0])
        done = [("REGISTERED", "HELD", 0, None)] * len(records) if held else handle_partition(config, records)
        pdf[["status", "resolution", "attempts", "last_error"]] = pd.DataFrame(done, index=pdf.index, dtype=object)
        return pdf.assign(batch_id=batch_id, attempts=pdf["attempts"].astype("int32"))[_COLUMNS]

    return rows.groupBy(*KEYS).applyInPandas(run, LEDGER_SCHEMA)


class Pipeline:
    """Runs a configuration over a streaming log (topic, part, off, k, v, ts)."""

    def __init__(self, spark: SparkSession, config: PipelineConfig, log: DataFrame, folder: str, pause_file: str | None = None):
        self.spark, self.config, self.log, self.folder, self.pause_file = spark, config, log, folder.rstrip("/"), pause_file
        self.query: StreamingQuery | None = None
        self.store = Store(spark, f"{self.folder}/state")
        self.counters = Counters() if config.metrics else Muted()
        self.in_flight, self.in_flight_bytes, self.status = 0, 0, "OK"
        built_in = [record_sensor(config.records, lambda: self.in_flight)]
        built_in += [byte_sensor(config.bytes_, lambda: self.in_flight_bytes)] if config.bytes_.enabled else []
        built_in += [heap_sensor(config.heap, lambda: heap_ratio(spark))] if config.heap.enabled else []
        self.pressure = Controller([*built_in, *config.sensors], config.records.enabled)
        self.assigned: set[Partition] = set()
        self.revoked: set[Partition] = set()
        self._busy = threading.RLock()  # held while a batch is handled or the state is changed
        self._stopping, self._ended, self._started = threading.Event(), threading.Event(), False
        self._threads: list[threading.Thread] = []

    # ---- ledger and state

    def history(self) -> DataFrame:
        """All ledger rows written so far."""
        try:
            return self.spark.read.schema(LEDGER_SCHEMA).parquet(f"{self.folder}/ledger/*")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LEDGER_SCHEMA)

    def ledger(self) -> DataFrame:
        """The latest row of each record; later batches and corrections win. For audits: nothing here runs it."""
        last = F.max_by(F.struct(*_COLUMNS), F.struct("batch_id", F.col("status") == "DONE"))
        return self.history().groupBy(*KEYS, "off").agg(last.alias("x")).select("x.*")

    def committable(self) -> DataFrame:
        return self.store.latest()[0].where("committable is not null").select(*KEYS, "committable")

    def commit_map(self) -> dict[Partition, int]:
        return {(r["topic"], r["part"]): r["committable"] for r in self.committable().collect()}  # a row a partition

    def dead_letters(self) -> DataFrame:
        return self.ledger().where("resolution = 'DLQ_SUCCESS'")

    def failed(self) -> DataFrame:
        return offsets.failed_partitions(self.store.latest()[1])

    def _advance(self, name: str, rows: DataFrame, corrected: bool = False) -> None:
        marks, held = advanced(*self.store.before(name), rows, self.config.errors.dead_letter is not None, corrected)
        self.store.write(name, marks, held)
        self._measure()

    def _measure(self) -> None:
        """What is in flight: registered or failed, and not done."""
        open_ = self.store.latest()[1].where("status <> 'DONE'").agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        self.in_flight, self.in_flight_bytes = open_[0], open_[1]

    def _next_id(self) -> int:
        top = self.history().agg(F.max("batch_id")).first()[0]
        return 0 if top is None else top + 1

    def resolve(self, topic: str, part: int, off: int) -> None:
        """Marks a failed record as done by hand; the partition stays failed while it has another failure."""
        with self._busy:
            row = self.store.latest()[1].where((F.col("topic") == topic) & (F.col("part") == part) & (F.col("off") == off) & (F.col("status") == "FAILED"))
            if row.isEmpty():
                raise ValueError(f"{topic}/{part} has no failure at {off}")
            name = f"resolved-{topic}-{part}-{off}-{self._next_id()}"
            fixed = row.withColumns({"status": F.lit("DONE"), "last_error": F.lit(None).cast("string"), "batch_id": F.lit(self._next_id()).cast("long")})
            fixed.select(*_COLUMNS).write.mode("overwrite").parquet(f"{self.folder}/ledger/{name}")
            self._advance(name, self.spark.read.schema(LEDGER_SCHEMA).parquet(f"{self.folder}/ledger/{name}"), corrected=True)

    def replay(self) -> None:
        """Handles the held records of partitions that aren't failed any more."""
        with self._busy:
            held = self.store.latest()[1].where("resolution = 'HELD'").join(F.broadcast(self.failed().select(*KEYS)), KEYS, "left_anti")
            number = self._next_id()
            self._write(held, number, f"replay-{number}")

    # ---- running

    def _write(self, batch: DataFrame, batch_id: int, name: str) -> None:
        blocked = offsets.failed_partitions(self.store.before(name)[1]).select(*KEYS)
        done = outcomes(batch.select("topic", "part", "off", "k", "v"), self.config, blocked, batch_id)
        done.write.mode("overwrite").parquet(f"{self.folder}/ledger/{name}")
        self._advance(name, self.spark.read.schema(LEDGER_SCHEMA).parquet(f"{self.folder}/ledger/{name}"))

    def _batch(self, batch: DataFrame, batch_id: int) -> None:
        with self._busy:
            there = {(r["topic"], r["part"]) for r in batch.select(*KEYS).distinct().collect()}  # a row a partition
            self.counters.add("poll_count")
            self.assigned |= there - self.revoked
            if there & self.revoked:
                gone = self.spark.createDataFrame(sorted(self.revoked), "topic string, part int")
                batch, there = batch.join(F.broadcast(gone), KEYS, "left_anti"), there - self.revoked
            if there:
                self._write(batch, batch_id, f"batch-{batch_id}")
            else:
                self.counters.add("empty_poll_count")
            self.admit()

    def admit(self) -> str:
        """Evaluates all sensors; pauses the source while the worst isn't OK, and lets it go on after."""
        now = self.pressure.evaluate()
        if now != "OK" and self.status == "OK":
            self.counters.add("throttle_count")
            log.debug("paused: %s", self.pressure.summary())
        self.status = now
        if self.pause_file:
            if now != "OK":
                open(self.pause_file, "w").close()
            elif os.path.exists(self.pause_file):
                os.remove(self.pause_file)
        return now

    def _query(self, available_now: bool) -> StreamingQuery:
        writer = self.log.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.folder}/checkpoint")
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{self.config.poll_ms} milliseconds")
        return writer.start()

    def _supervise(self, available_now: bool) -> None:
        failures = 0
        try:
            while not self._stopping.is_set():
                try:
                    self.query = self._query(available_now)
                    while not self.query.awaitTermination(1) and not self._stopping.is_set():
                        pass
                    if self._stopping.is_set():
                        break
                    moved = any(p["numInputRows"] for p in self.query.recentProgress)
                    failures = 0
                    if available_now and not moved:
                        break
                except Exception:
                    moved = self.query is not None and any(p["numInputRows"] for p in self.query.recentProgress)
                    failures = 1 if moved else failures + 1
                    log.exception("the query failed; it starts anew from its checkpoint")
                    if self.config.max_restarts is not None and failures > self.config.max_restarts:
                        break
                    self._stopping.wait(self.config.restart_ms / 1000)
        finally:
            self._shut_down()

    def start(self, available_now: bool = False) -> Pipeline:
        """Runs in the background; available_now ends when all that is there was handled. Works once."""
        if self._started:
            raise RuntimeError("the pipeline was started before")
        self._started = True
        marks = self.store.latest()[0].select(*KEYS).collect()
        self.assigned |= {(r["topic"], r["part"]) for r in marks} - self.revoked
        self._measure()
        self._threads = [threading.Thread(target=self._supervise, args=(available_now,), name="tidemark-supervisor", daemon=True), threading.Thread(target=self._commits, name="tidemark-committer", daemon=True)]
        atexit.register(self._at_exit)
        if threading.current_thread() is threading.main_thread():
            self._earlier = signal.signal(signal.SIGTERM, self._terminated)
        for t in self._threads:
            t.start()
        return self

    @property
    def is_running(self) -> bool:
        return self._started and not self._ended.is_set()

    def awaitTermination(self, seconds: float | None = None) -> bool:  # noqa: N802 (as a query's)
        """Waits for the end of the shutdown; False if that takes longer."""
        return self._ended.wait(seconds)

    def drain(self, timeout_ms: int | None = None) -> bool:
        """Waits until no batch is being handled; False if that takes too long."""
        done = self._busy.acquire(timeout=(self.config.drain_ms if timeout_ms is None else timeout_ms) / 1000)
        if done:
            self._busy.release()
        return done

    def stop(self) -> None:
        """Asks for a graceful end; may be called again."""
        self._stopping.set()

    def _shut_down(self) -> None:
        """The running batch ends, the query stops, what is committable is committed, the threads end."""
        self._stopping.set()
        try:
            if not self.drain(self.config.shutdown_ms):
                log.warning("a batch is still being handled after %d ms", self.config.shutdown_ms)
            if self.query is not None and self.query.isActive:
                self.query.stop()
        except Exception:
            log.warning("stopping the query failed", exc_info=True)
        self.commit()
        self._ended.set()
        atexit.unregister(self._at_exit)
        log.info("the pipeline has ended")

    def _at_exit(self) -> None:
        self.stop()
        self.awaitTermination((self.config.shutdown_ms + self.config.drain_ms) / 1000)

    def _terminated(self, number, frame) -> None:
        self._at_exit()
        if callable(self._earlier):
            self._earlier(number, frame)
        else:
            raise SystemExit(128 + number)

    # ---- commits

    def commit(self) -> bool:
        """Commits what is committable, if anything is; a failure is counted and logged, never raised."""
        try:
            offsets_ = self.commit_map()
            if not offsets_:
                return False
            if self.config.commit is not None:
                self.config.commit(offsets_)
            else:
                rows = [(t, p, n) for (t, p), n in sorted(offsets_.items())]
                self.spark.createDataFrame(rows, "topic string, part int, committed long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/committed")
            self.counters.add("commit_successes")
            return True
        except Exception as e:
            self.counters.add("commit_failures")
            log.warning("the commit failed: %s", e)
            return False

    def _commits(self) -> None:
        while not self._stopping.wait(self.config.commit_ms / 1000):
            self.commit()

    # ---- rebalance

    def revoke(self, partitions: set[Partition]) -> None:
        """Takes partitions away: their open records are abandoned, the running batch drains, commits, and their state goes."""
        mine = set(partitions)
        if not mine:
            return
        self.counters.add("rebalance_count")
        self.revoked |= mine
        self.assigned -= mine
        if not self.drain():
            self.counters.add("drain_timeouts", len(mine))
        with self._busy:
            gone = self.spark.createDataFrame(sorted(mine), "topic string, part int")
            marks, held = self.store.latest()
            self.counters.add("records_abandoned", offsets.abandoned(held, gone).count())
            self.commit()
            self.store.write(f"revoked-{self._next_id()}-{time.time_ns()}", *(x.join(F.broadcast(gone), KEYS, "left_anti") for x in (marks, held)))
            self._measure()

    def assign(self, positions: dict[Partition, int]) -> None:
        """Gives partitions, each to go on from a position; one that is assigned already is refused."""
        if not positions:
            return
        with self._busy:
            marks, held = self.store.latest()
            known = self.assigned | {(r["topic"], r["part"]) for r in marks.select(*KEYS).collect()}
            if known & positions.keys():
                raise ValueError(f"assigned before: {sorted(known & positions.keys())}")
            new = self.spark.createDataFrame([(t, p, n) for (t, p), n in sorted(positions.items())], "topic string, part int, base long")
            self.store.write(f"assigned-{self._next_id()}-{time.time_ns()}", marks.unionByName(new, allowMissingColumns=True), held)
            self.assigned |= positions.keys()
            self.revoked -= positions.keys()

    # ---- metrics

    def metrics(self) -> PipelineMetrics:
        """A snapshot, also before the start; it reads the last status and evaluates no sensor."""
        if not self.config.metrics:
            return PipelineMetrics()
        marks = self.store.latest()[0].collect()  # a row a partition
        total = {c: sum(r[c] or 0 for r in marks) for c in COUNTERS}
        lag = lambda r: 0 if r["highest"] is None else r["highest"] + 1 - (r["base"] if r["committable"] is None else r["committable"])
        names = {"processed": "records_processed", "failed": "records_failed", "skipped": "records_skipped", "retries": "retry_attempts", "dlq_ok": "dlq_successes", "dlq_failed": "dlq_failures"}
        return PipelineMetrics(
            **{names.get(c, c): n for c, n in total.items()}, **self.counters.values(), in_flight_records=self.in_flight, in_flight_bytes=self.in_flight_bytes, backpressure_status=self.status,
            partition_lags={(r["topic"], r["part"]): lag(r) for r in marks if (r["topic"], r["part"]) in self.assigned}, assigned_partitions=frozenset(self.assigned),
        )
