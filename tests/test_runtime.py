"""The runtime's scenarios: counts and commit positions as the reference's end-to-end tests have them."""

import os
import time
from collections import namedtuple

import pytest

from tidemark.config import ErrorPolicy, Fallback, PipelineConfig, ThreadMode, Thresholds
from tidemark.sources.plog import append, read_plog
from tidemark.streaming.counters import PipelineMetrics
from tidemark.streaming.runtime import Pipeline, handle_partition
from tidemark.streaming.sensors import Controller, Sensor, heap_ratio, record_sensor


def run(spark, tmp_path, config, feed, **options):
    log = str(tmp_path / "log")
    for (topic, part), values in feed.items():
        append(log, topic, part, [(f"key-{i}", v) for i, v in enumerate(values)])
    p = Pipeline(spark, config, read_plog(spark, log, **options), str(tmp_path / "run"))
    assert p.start(available_now=True).awaitTermination(120) and not p.is_running
    return p


def committed(p):
    return {(r["topic"], r["part"]): r["committable"] for r in p.committable().collect()}


def nothing(record):
    pass


def poison(record):
    if record.v == "poison":
        raise ValueError("bad record")


def always(record):
    raise ValueError("no")


SKIP = ErrorPolicy(base_ms=1, fallback=Fallback.SKIP)


def test_partitions_commit_all(spark, tmp_path):
    p = run(spark, tmp_path, PipelineConfig(("t",), nothing), {("t", k): [f"value-{i}" for i in range(30)] for k in range(3)})
    assert p.metrics().records_processed == 90 and committed(p) == {("t", k): 30 for k in range(3)}


def test_skip_passes_a_poison_record(spark, tmp_path):
    p = run(spark, tmp_path, PipelineConfig(("t",), poison, errors=SKIP, concurrency=2), {("t", 0): ["good", "poison", "good"]})
    m = p.metrics()
    assert (m.records_processed, m.records_skipped, committed(p)[("t", 0)]) == (2, 1, 3)


def test_hook_skips_without_handling(spark, tmp_path):
    p = run(spark, tmp_path, PipelineConfig(("t",), nothing, before=lambda r: r.v != "duplicate"), {("t", 0): ["a", "duplicate", "b"]})
    m = p.metrics()
    assert (m.records_processed, m.records_skipped, committed(p)[("t", 0)]) == (2, 1, 3)


def test_dead_letter_after_retries(spark, tmp_path):
    policy = ErrorPolicy(max_retries=2, base_ms=1, dead_letter=lambda record, error: None)
    p = run(spark, tmp_path, PipelineConfig(("t",), always, errors=policy), {("t", 0): ["x"]})
    m = p.metrics()
    assert (m.dlq_successes, m.retry_attempts, committed(p)[("t", 0)]) == (1, 2, 1)
    assert "no" in p.dead_letters().first()["last_error"]


def test_failed_partition_holds_and_resumes(spark, tmp_path):
    p = run(spark, tmp_path, PipelineConfig(("t",), poison), {("t", 0): ["a", "poison", "b", "c"], ("t", 1): ["a", "b"]})
    assert committed(p) == {("t", 0): 1, ("t", 1): 2}
    assert {(r["part"], r["off"]): r["resolution"] for r in p.ledger().where("status <> 'DONE'").collect()} == {(0, 1): "FAIL_PARTITION", (0, 2): "HELD", (0, 3): "HELD"}
    p.resolve("t", 0, 1)
    p.replay()
    assert committed(p) == {("t", 0): 4, ("t", 1): 2} and p.failed().isEmpty()
    with pytest.raises(ValueError):
        p.resolve("t", 0, 1)


def test_batch_handler_is_all_or_nothing(spark, tmp_path):
    def bad(topic, part, records):
        raise ValueError(len(records))

    p = run(spark, tmp_path, PipelineConfig(("t",), batch_handler=bad, errors=SKIP), {("t", 0): list("abcde")})
    assert committed(p)[("t", 0)] == 5 and p.metrics().records_skipped == 5
    q = run(spark, tmp_path / "two", PipelineConfig(("t",), batch_handler=bad), {("t", 0): list("abcde")})
    assert committed(q) == {} and q.failed().first()["failed_off"] == 0


def test_restart_loses_nothing(spark, tmp_path):
    config = PipelineConfig(("t",), nothing)
    first = run(spark, tmp_path, config, {("t", 0): ["a"] * 5})
    assert committed(first)[("t", 0)] == 5
    again = run(spark, tmp_path, config, {("t", 0): ["b"] * 3, ("t", 1): ["c"]})
    assert committed(again) == {("t", 0): 8, ("t", 1): 1}
    with pytest.raises(RuntimeError):
        again.start()


def test_source_reads_by_batch_too(spark, tmp_path):
    append(str(tmp_path), "t", 0, [("k", "v"), (None, None)])
    rows = read_plog(spark, str(tmp_path), stream=False).orderBy("off").collect()
    assert [(r["topic"], r["part"], r["off"], r["k"], r["v"]) for r in rows] == [("t", 0, 0, "k", "v"), ("t", 0, 1, None, None)]


def test_throttle_pauses_the_source(spark, tmp_path):
    pause = str(tmp_path / "pause")
    config = PipelineConfig(("t",), nothing, records=Thresholds(1, 3, 10))
    p = Pipeline(spark, config, read_plog(spark, str(tmp_path)), str(tmp_path / "run"), pause)
    for n, status, there in ((3, "THROTTLE", True), (2, "THROTTLE", True), (1, "OK", False)):
        p.in_flight = n
        assert p.admit() == status and os.path.exists(pause) == there
    assert p.metrics().throttle_count == 1
    append(str(tmp_path / "log"), "t", 0, [("k", "v")])
    (tmp_path / "pause").touch()
    q = read_plog(spark, str(tmp_path / "log"), pauseFile=pause).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(x["numInputRows"] for x in q.recentProgress) == 0


@pytest.mark.parametrize("cap", [None, "500"])
def test_available_now_delivers_everything(spark, tmp_path, cap):
    options = {} if cap is None else {"maxOffsetsPerPartition": cap, "positionFile": str(tmp_path / "position")}
    p = run(spark, tmp_path, PipelineConfig(("t",), nothing), {("t", 0): ["v"] * 1203, ("t", 1): ["v"] * 7}, **options)
    m = p.metrics()
    assert m.records_processed == 1210 and committed(p) == {("t", 0): 1203, ("t", 1): 7}
    assert m.poll_count == (1 if cap is None else 3) and m.partition_lags == {("t", 0): 0, ("t", 1): 0} and m.commit_successes >= 1
    assert {(r["part"], r["committed"]) for r in spark.read.parquet(f"{p.folder}/committed").collect()} == {(0, 1203), (1, 7)}


def until(true, seconds=60):
    end = time.time() + seconds
    while not true() and time.time() < end:
        time.sleep(0.2)
    return true()


def test_continuous_feed_rebalance_and_stop(spark, tmp_path):
    path, seen = str(tmp_path / "log"), []
    append(path, "t", 0, [("k", "v")] * 1300)
    log = read_plog(spark, path, maxOffsetsPerPartition="500", positionFile=str(tmp_path / "position"))
    p = Pipeline(spark, PipelineConfig(("t",), nothing, commit=seen.append, commit_ms=200), log, str(tmp_path / "run"))
    assert p.metrics() == PipelineMetrics() and not p.is_running
    p.start()
    assert p.is_running and until(lambda: p.metrics().records_processed == 1300)
    append(path, "t", 1, [("k", "v")] * 10)
    assert until(lambda: committed(p) == {("t", 0): 1300, ("t", 1): 10})
    assert until(lambda: {("t", 0): 1300, ("t", 1): 10} in seen)  # by the periodic committer
    p.revoke({("t", 1)})
    append(path, "t", 1, [("k", "v")] * 5)
    append(path, "t", 0, [("k", "v")] * 5)
    assert until(lambda: committed(p) == {("t", 0): 1305})
    assert p.metrics().assigned_partitions == {("t", 0)} and p.metrics().rebalance_count == 1 and p.metrics().records_abandoned == 0
    p.drain()
    with pytest.raises(ValueError):
        p.assign({("t", 0): 0})
    p.assign({("t", 1): 15})
    append(path, "t", 1, [("k", "v")] * 2)
    assert until(lambda: committed(p) == {("t", 0): 1305, ("t", 1): 17})
    p.stop()
    p.stop()
    assert p.awaitTermination(60) and not p.is_running and not p.query.isActive and seen[-1] == {("t", 0): 1305, ("t", 1): 17}


def test_revoking_counts_abandoned_records_once(spark, tmp_path):
    p = run(spark, tmp_path, PipelineConfig(("t",), poison), {("t", 0): ["a", "poison", "b", "c"], ("t", 1): ["a"]})
    assert p.metrics().in_flight_records == 3
    p.revoke({("t", 0)})
    m = p.metrics()
    assert m.records_abandoned == 3 and m.in_flight_records == 0 and m.assigned_partitions == {("t", 1)} and committed(p) == {("t", 1): 1}


def test_a_failing_query_starts_anew(spark, tmp_path):
    class Flaky(Pipeline):
        broken = 2

        def _query(self, available_now):
            if self.broken:
                self.broken -= 1
                raise RuntimeError("no broker")
            return super()._query(available_now)

    append(str(tmp_path / "log"), "t", 0, [("k", "v")] * 3)
    p = Flaky(spark, PipelineConfig(("t",), nothing, restart_ms=1), read_plog(spark, str(tmp_path / "log")), str(tmp_path / "run"))
    assert p.start(available_now=True).awaitTermination(60) and committed(p) == {("t", 0): 3}
    q = Flaky(spark, PipelineConfig(("t",), nothing, restart_ms=1, max_restarts=1), read_plog(spark, str(tmp_path / "log")), str(tmp_path / "other"))
    assert q.start(available_now=True).awaitTermination(60) and committed(q) == {}


def test_failing_commits_are_counted_not_raised(spark, tmp_path):
    def broken(offsets):
        raise OSError("no broker")

    m = run(spark, tmp_path, PipelineConfig(("t",), nothing, commit=broken), {("t", 0): ["a"]}).metrics()
    assert (m.records_processed, m.commit_successes) == (1, 0) and m.commit_failures >= 1


def test_muted_metrics(spark, tmp_path):
    assert run(spark, tmp_path, PipelineConfig(("t",), nothing, metrics=False), {("t", 0): ["a"]}).metrics() == PipelineMetrics()


Rec = namedtuple("Rec", "topic part off k v")


def records(*values):
    return [Rec("t", 0, i, "k", v) for i, v in enumerate(values)]


def test_hooks_after_and_on_error():
    after, errors = [], []
    config = PipelineConfig(("t",), poison, after=lambda r: after.append(r.off), on_error=lambda r, n, e: errors.append((r.off, n)), errors=ErrorPolicy(max_retries=1, base_ms=1, fallback=Fallback.SKIP))
    out = handle_partition(config, records("a", "poison", "b"))
    assert [x[1] for x in out] == ["SUCCESS", "SKIP", "SUCCESS"] and after == [0, 2] and errors == [(1, 0), (1, 1)]
    flaky = PipelineConfig(("t",), nothing, after=always, errors=ErrorPolicy(max_retries=2, base_ms=1, fallback=Fallback.SKIP))
    assert handle_partition(flaky, records("a"))[0][1:3] == ("SKIP", 3)  # a failing hook is retried like the handler


@pytest.mark.parametrize("mode, least", [(ThreadMode.VIRTUAL, 40), (ThreadMode.PLATFORM, 4)])
def test_concurrency(mode, least):
    import threading

    lock, now, top = threading.Lock(), [0], [0]

    def slow(record):
        with lock:
            now[0] += 1
            top[0] = max(top[0], now[0])
        time.sleep(0.05)
        with lock:
            now[0] -= 1

    out = handle_partition(PipelineConfig(("t",), slow, threads=mode, concurrency=4), records(*"a" * 40))
    assert [x[0] for x in out] == ["DONE"] * 40 and top[0] == least


def test_batch_handler_gets_polls_of_the_limit():
    sizes = []
    config = PipelineConfig(("t",), batch_handler=lambda t, p, rows: sizes.append(len(rows)) or (1 / 0 if len(sizes) == 2 else None), batch_limit=3)
    out = handle_partition(config, records(*"abcdefgh"))
    assert sizes == [3, 3] and [x[1] for x in out] == ["SUCCESS"] * 3 + ["FAIL_PARTITION"] + ["HELD"] * 4


def test_start_positions(spark, tmp_path):
    append(str(tmp_path / "log"), "t", 0, [("k", str(i)) for i in range(5)])
    for begin, want in (("earliest", 5), ("latest", 0), ('{"t/0": 3}', 2)):
        log = read_plog(spark, str(tmp_path / "log"), startingOffsets=begin)
        p = Pipeline(spark, PipelineConfig(("t",), nothing), log, str(tmp_path / f"run{want}"))
        assert p.start(available_now=True).awaitTermination(60) and p.metrics().records_processed == want


@pytest.mark.parametrize(
    "limits, samples, expected",
    [
        ((60, 100, 500), (0, 100, 50, 80, 105), "OK THROTTLE OK OK THROTTLE"),
        ((60, 100, 500), (100, 90, 95, 75, 85), "THROTTLE THROTTLE THROTTLE THROTTLE THROTTLE"),
        ((60, 100, 500), (500, 90), "CRITICAL THROTTLE"),
        ((100, 200, 400), (0, 200, 400, 150, 50), "OK THROTTLE CRITICAL THROTTLE OK"),
        ((0.5, 0.7, 0.9), (0.1, 0.7, 0.9, 0.6, 0.5), "OK THROTTLE CRITICAL THROTTLE OK"),
    ],
)
def test_sensor_fixtures(spark, limits, samples, expected):
    live = Sensor(Thresholds(*limits))
    assert [live.judge(x) for x in samples] == expected.split()
    from tidemark.operators.pressure import sensor

    df = spark.createDataFrame(list(enumerate(map(float, samples))), "seq long, x double")
    assert [r["status"] for r in sensor(df, "seq", "x", Thresholds(*limits)).orderBy("seq").collect()] == expected.split()


class Fixed:
    def __init__(self, name, status):
        self.name, self._status, self.asked = name, status, 0

    def status(self):
        self.asked += 1
        return self._status

    def detail(self):
        return "full"


def test_worst_of_sensors(spark):
    late = Fixed("late", "OK")
    assert Controller([Fixed("a", "OK"), Fixed("b", "THROTTLE")]).evaluate() == "THROTTLE"
    assert Controller([Fixed("a", "CRITICAL"), late]).evaluate() == "CRITICAL" and not late.asked
    assert Controller([Fixed("a", "CRITICAL")], enabled=False).evaluate() == "OK"
    assert Controller([], enabled=False).summary() == "backpressure=disabled"
    live = record_sensor(Thresholds(1, 3, 10), lambda: 5)
    assert live.status() == "THROTTLE" and Controller([live, Fixed("mine", "OK")]).summary() == "backpressure{records=5/3 in-flight [throttled], mine=full}"
    assert 0 < heap_ratio(spark) < 1
