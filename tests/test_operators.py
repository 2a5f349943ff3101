"""Operators against fixtures and brute force, and every registered query against DuckDB."""

import glob
import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import Backoff, ErrorPolicy, PipelineConfig, Thresholds
from tidemark.functions.scalars import backoff_ms, format_bytes, record_bytes
from tidemark.operators import offsets
from tidemark.operators.running import last_known, running_sums
from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def ledger(spark, statuses, base=0):
    rows = [("t", 0, o, s) for o, s in statuses.items()]
    return spark.createDataFrame(rows, "topic string, part int, off long, status string")


def mark(spark, statuses):
    return offsets.committable(ledger(spark, statuses)).first()["committable"]


@pytest.mark.parametrize(
    "statuses, expected",
    [
        ({100: "IN_PROGRESS", 101: "IN_PROGRESS", 102: "DONE"}, None),
        ({100: "DONE", 101: "IN_PROGRESS", 102: "DONE"}, 101),
        ({100: "DONE", 101: "DONE", 102: "DONE", 103: "REGISTERED"}, 103),
        ({100: "DONE", 101: "DONE", 105: "DONE"}, 106),
        ({100: "DONE", 101: "DONE", 102: "FAILED"}, 102),
    ],
)
def test_committable_fixtures(spark, statuses, expected):
    assert mark(spark, statuses) == expected


def test_committable_against_the_shrinking_window(spark):
    rng, rows, expected = random.Random(5), [], {}
    for part in range(200):
        off, last, open_ = 0, None, False
        for _ in range(rng.randrange(1, 12)):
            off += rng.randrange(1, 4)
            status = rng.choice(["DONE", "DONE", "DONE", "REGISTERED", "IN_PROGRESS", "FAILED"])
            rows.append(("t", part, off, status))
            open_ = open_ or status != "DONE"
            last = last if open_ else off + 1
        expected[part] = last
    df = spark.createDataFrame(rows, "topic string, part int, off long, status string")
    assert {r["part"]: r["committable"] for r in offsets.committable(df).collect()} == expected


def test_drain_counts(spark):
    got = offsets.drain_result(ledger(spark, {o: "DONE" if o < 103 else "IN_PROGRESS" for o in range(100, 105)})).first()
    assert (got["completed"], got["abandoned"], got["committable"], got["all_completed"]) == (3, 2, 103, False)


def test_resolving_one_of_two_failures_keeps_the_partition_failed(spark):
    rows = [("t", 0, o, s, f) for o, s, f in ((0, "DONE", False), (1, "FAILED", True), (2, "REGISTERED", False), (3, "REGISTERED", True), (4, "REGISTERED", False))]
    out = offsets.resolve_failure(spark.createDataFrame(rows, "topic string, part int, off long, status string, would_fail boolean"))
    assert {r["off"]: r["status"] for r in out.collect()} == {0: "DONE", 1: "DONE", 2: "DONE", 3: "FAILED", 4: "REGISTERED"}


def test_window_full(spark):
    df = spark.range(10_000).select(F.lit("t").alias("topic"), F.lit(0).alias("part"), F.col("id").alias("off"), F.lit("REGISTERED").alias("status"))
    row = offsets.window_occupancy(df).first()
    assert row["occupied"] == 10_000 and row["is_full"]


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_running_equals_plain(spark, chunk):
    rng = random.Random(chunk)
    rows = [(rng.choice("ab"), i, rng.choice([None, 1, 2, 3])) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, o long, x long")
    sums = {(r["g"], r["o"]): r["s"] for r in running_sums(df, ["g"], ["o"], {"s": F.col("x")}, chunk).collect()}
    known = {(r["g"], r["o"]): r["y"] for r in last_known(df, ["g"], "o", {"y": F.col("x")}, chunk).collect()}
    total, last = {}, {}
    for g, o, x in rows:
        total[g] = total.get(g, 0) + (x or 0)
        last[g] = x if x is not None else last.get(g)
        assert sums[g, o] == total[g] and known[g, o] == last[g]


@pytest.mark.parametrize(
    "policy, expected",
    [
        (ErrorPolicy(base_ms=100, backoff=Backoff.EXPONENTIAL, max_ms=500), {-1: 100, 0: 100, 1: 200, 2: 400, 3: 500, 10: 500}),
        (ErrorPolicy(base_ms=100, backoff=Backoff.EXPONENTIAL, max_ms=0), {1: 200, 2: 400, 5: 3200, 50: 100 << 30}),
        (ErrorPolicy(base_ms=0, backoff=Backoff.EXPONENTIAL), {0: 0, 4: 0}),
        (ErrorPolicy(base_ms=70_000), {0: 70_000, 9: 70_000}),
    ],
)
def test_backoff(spark, policy, expected):
    df = spark.createDataFrame([(a,) for a in expected], "a int")
    assert {r["a"]: r["d"] for r in df.select("a", backoff_ms(F.col("a"), policy).alias("d")).collect()} == expected
    assert {a: policy.delay_ms(a) for a in expected} == expected


def test_scalars(spark):
    df = spark.createDataFrame([("é", None, 1280), (None, "ab", 1023)], "k string, v string, n long")
    rows = df.select(record_bytes(F.col("k"), F.col("v")).alias("b"), format_bytes(F.col("n")).alias("t")).collect()
    assert [tuple(r) for r in rows] == [(2, "1.3KB"), (2, "1023B")]


@pytest.mark.parametrize("make", [lambda: Thresholds(5, 5, 9), lambda: Thresholds(1, 9, 9), lambda: ErrorPolicy(max_retries=-1), lambda: PipelineConfig((), print), lambda: PipelineConfig(("t",)), lambda: PipelineConfig(("t",), print, print), lambda: PipelineConfig(("t",), batch_handler=print, before=print), lambda: PipelineConfig(("t",), print, poll_ms=0)])
def test_bad_configuration(make):
    with pytest.raises(ValueError):
        make()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    tidy = lambda x: None if pd.isna(x) else round(float(x), 9) if isinstance(x, float) else x.item() if hasattr(x, "item") else x
    return sorted((tuple(map(tidy, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_oracle(spark, duck, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(duck.execute(ORACLES[name]).df())


def test_batches_are_registered_whole_or_not_at_all(spark):
    calls = [(100, 104), (102, 102), (90, 100), (95, 99), (7, 6), (200, 10_190), (200, 10_189), (105, 105)]
    rows = [("t", 0, i, a, b) for i, (a, b) in enumerate(calls)]
    out = offsets.register_batches(spark.createDataFrame(rows, "topic string, part int, seq long, first_off long, last_off long")).orderBy("seq").collect()
    assert [r["verdict"] for r in out] == ["ACCEPTED", "DUPLICATE", "DUPLICATE", "ACCEPTED", "EMPTY_RANGE", "FULL", "ACCEPTED", "FULL"]


def test_marks_of_ranges_take_only_records_in_the_needed_state(spark):
    rows = ledger(spark, {1: "REGISTERED", 2: "IN_PROGRESS", 3: "REGISTERED", 5: "REGISTERED"})
    marks = spark.createDataFrame([("t", 0, 1, 4), ("t", 0, 2, 3)], "topic string, part int, first_off long, last_off long")
    out = offsets.mark_ranges(rows, marks, "REGISTERED", "IN_PROGRESS").orderBy("off").collect()
    assert [r["status"] for r in out] == ["IN_PROGRESS", "IN_PROGRESS", "IN_PROGRESS", "REGISTERED"]


def test_a_partition_begins_at_its_base_and_only_once(spark):
    rows = ledger(spark, {99: "REGISTERED", 100: "DONE", 101: "IN_PROGRESS"})
    starts = spark.createDataFrame([("t", 0, 100), ("t", 1, 7)], "topic string, part int, base long")
    out = {r["part"]: (r["committable"], r["lag"]) for r in offsets.based(rows, starts).collect()}
    assert out == {0: (101, 1), 1: (None, 0)}
    with pytest.raises(Exception, match="assigned twice"):
        offsets.based(rows, starts.unionByName(starts)).collect()


def test_resolving_can_commit_up_to_the_next_failure(spark):
    rows = [("t", 0, o, s, f) for o, s, f in ((1, "DONE", False), (2, "FAILED", True), (3, "REGISTERED", False), (5, "REGISTERED", True), (6, "REGISTERED", False))]
    rows += [("t", 1, 1, "DONE", False), ("t", 2, 1, "FAILED", True)]
    out = offsets.resolved_committable(spark.createDataFrame(rows, "topic string, part int, off long, status string, would_fail boolean")).collect()
    assert {r["part"]: (r["before"], r["after"]) for r in out} == {0: (2, 4), 1: (2, 2), 2: (None, 2)}
