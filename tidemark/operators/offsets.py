"""Offset tracking as DataFrame rules over a ledger (topic, part, off, status, ...).

Every rule is a partial aggregation by partition, joined back where rows need it; none sorts a
whole partition in one task.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import TRANSITIONS, WINDOW_LIMIT

KEYS = ["topic", "part"]


def committable(ledger: DataFrame) -> DataFrame:
    """(topic, part, committable): one past the last DONE before the first record that isn't DONE; null without progress.

    Gaps between offsets don't block.
    """
    first = ledger.groupBy(*KEYS).agg(F.min(F.when(F.col("status") != "DONE", F.col("off"))).alias("first_open"))
    ahead = F.col("first_open").isNull() | (F.col("off") < F.col("first_open"))
    done = ledger.select(*KEYS, "off").join(first, KEYS).groupBy(*KEYS).agg(F.max(F.when(ahead, F.col("off"))).alias("last_done"))
    return done.select(*KEYS, (F.col("last_done") + 1).alias("committable"))


def based(ledger: DataFrame, starts: DataFrame) -> DataFrame:
    """(topic, part, base, committable, lag) of partitions that begin at a base (topic, part, base); one given twice is an error.

    A partition without records has lag 0; what lies ahead of its base isn't its own.
    """
    checked = starts.groupBy(*KEYS).agg(F.max("base").alias("base"), F.count("*").alias("n"))
    checked = checked.withColumn("base", F.when(F.col("n") == 1, F.col("base")).otherwise(F.raise_error(F.concat(F.lit("assigned twice: "), F.concat_ws("-", "topic", "part"))).cast("long"))).drop("n")
    own = ledger.join(F.broadcast(checked), KEYS).where("off >= base")
    ends = own.groupBy(*KEYS).agg(F.max("off").alias("last"))
    rows = checked.join(ends, KEYS, "left").join(committable(own), KEYS, "left")
    lag = F.coalesce(F.col("last") + 1 - F.coalesce("committable", "base"), F.lit(0).cast("long"))
    return rows.select(*KEYS, "base", "committable", lag.alias("lag"))


def register_batches(batches: DataFrame, limit: int = WINDOW_LIMIT) -> DataFrame:
    """(topic, part, seq, first_off, last_off, verdict) of registrations of inclusive ranges, in the order of seq.

    EMPTY_RANGE: from exceeds to; FULL: the window would hold more than `limit`; DUPLICATE: an offset is registered
    already, and none of the range is. Only accepted ranges count for later ones, which makes a partition's
    batches (a few hundredths of its records) one sequence.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        starts, ends, held, verdicts = [], [], 0, []
        rows = rows.sort_values("seq")
        for a, b in zip(rows["first_off"].tolist(), rows["last_off"].tolist()):
            at = bisect.bisect_right(starts, b)
            if a > b:
                verdicts.append("EMPTY_RANGE")
            elif held + b - a + 1 > limit:
                verdicts.append("FULL")
            elif at and ends[at - 1] >= a:  # accepted ranges are apart, so the last that begins by b tells
                verdicts.append("DUPLICATE")
            else:
                starts.insert(at, a)
                ends.insert(at, b)
                held += b - a + 1
                verdicts.append("ACCEPTED")
        return rows.assign(verdict=verdicts)[[*KEYS, "seq", "first_off", "last_off", "verdict"]]

    return batches.select(*KEYS, "seq", "first_off", "last_off").groupBy(*KEYS).applyInPandas(run, "topic string, part int, seq long, first_off long, last_off long, verdict string")


def mark_ranges(ledger: DataFrame, marks: DataFrame, needed: str, becomes: str) -> DataFrame:
    """ledger with the status `becomes` where an inclusive range of marks (topic, part, first_off, last_off) covers a record in the state `needed`.

    Ranges become single offsets, so the join is on keys and no record is compared with ranges that don't hold it.
    """
    hit = expand_batches(marks).select(*KEYS, "off").distinct().withColumn("__hit", F.lit(True))
    rows = ledger.join(hit, [*KEYS, "off"], "left")
    return rows.withColumn("status", F.when(F.col("__hit") & (F.col("status") == needed), becomes).otherwise(F.col("status"))).drop("__hit")


def cleared(ledger: DataFrame, partitions: DataFrame) -> DataFrame:
    """ledger without these partitions."""
    return ledger.join(F.broadcast(partitions.distinct()), KEYS, "left_anti")


def progress(ledger: DataFrame, base: int = 0) -> DataFrame:
    """(topic, part, committable, lag, pending)."""
    ends = ledger.groupBy(*KEYS).agg(F.max("off").alias("last"), F.count_if(F.col("status") == "REGISTERED").alias("pending"))
    lag = F.col("last") + 1 - F.coalesce("committable", F.lit(base).cast("long"))
    return ends.join(committable(ledger), KEYS).select(*KEYS, "committable", lag.alias("lag"), "pending")


def commit_map(ledger: DataFrame) -> DataFrame:
    """(topic, part, committable) of partitions with progress."""
    return committable(ledger).where("committable is not null")


def partition_counts(ledger: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("REGISTERED", "IN_PROGRESS", "DONE", "FAILED")]
    return ledger.groupBy(*KEYS).agg(*counts)


def window_occupancy(ledger: DataFrame, limit: int = WINDOW_LIMIT) -> DataFrame:
    """(topic, part, occupied, is_full, is_failed): records from the first one that isn't DONE on."""
    mark = committable(ledger)
    beyond = F.col("committable").isNull() | (F.col("off") >= F.col("committable"))
    out = ledger.join(mark, KEYS).groupBy(*KEYS).agg(F.count_if(beyond).alias("occupied"), (F.count_if(F.col("status") == "FAILED") > 0).alias("is_failed"))
    return out.select(*KEYS, "occupied", (F.col("occupied") >= limit).alias("is_full"), "is_failed")


def drain_result(ledger: DataFrame) -> DataFrame:
    """(topic, part, all_completed, completed, abandoned, committable): abandoned are pending and in progress."""
    counts = ledger.groupBy(*KEYS).agg(F.count_if(F.col("status") == "DONE").alias("completed"), F.count_if(F.col("status").isin("REGISTERED", "IN_PROGRESS")).alias("abandoned"))
    return counts.join(committable(ledger), KEYS).select(*KEYS, (F.col("abandoned") == 0).alias("all_completed"), "completed", "abandoned", "committable")


def failed_partitions(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("status") == "FAILED").groupBy(*KEYS).agg(F.min("off").alias("failed_off"))


def held_records(ledger: DataFrame) -> DataFrame:
    """Records behind their partition's first failure."""
    return ledger.join(failed_partitions(ledger), KEYS).where(F.col("off") > F.col("failed_off")).select(*KEYS, "off", "status")


def resolve_failure(ledger: DataFrame, fails: str = "would_fail") -> DataFrame:
    """ledger after each partition's first failure was resolved by hand.

    That record is DONE; the ones behind it up to the next that would fail are released and DONE, and a
    partition is failed while any failure remains.
    """
    first = failed_partitions(ledger)
    later = ledger.join(first, KEYS).where((F.col("off") > F.col("failed_off")) & F.col(fails)).groupBy(*KEYS).agg(F.min("off").alias("next_off"))
    rows = ledger.join(first, KEYS, "left").join(later, KEYS, "left")
    moved = F.when(F.col("off") == F.col("next_off"), "FAILED").when(F.col("off") > F.col("next_off"), "REGISTERED").otherwise("DONE")
    status = F.when(F.col("failed_off").isNull() | (F.col("off") < F.col("failed_off")), F.col("status")).otherwise(moved)
    return rows.withColumn("status", status).drop("failed_off", "next_off")


def resolved_committable(ledger: DataFrame, fails: str = "would_fail") -> DataFrame:
    """(topic, part, before, after): what each partition could commit, and could once its first failure was resolved.

    One pass takes the first open record and the failures' bounds; each mark then is the highest offset below its bound.
    """
    first = ledger.groupBy(*KEYS).agg(F.min(F.when(F.col("status") != "DONE", F.col("off"))).alias("first_open"), F.min(F.when(F.col(fails), F.col("off"))).alias("failed_off"))
    below = lambda bound: F.max(F.when(bound.isNull() | (F.col("off") < bound), F.col("off"))) + 1
    second = ledger.where(F.col(fails)).join(F.broadcast(first), KEYS).where(F.col("off") > F.col("failed_off")).groupBy(*KEYS).agg(F.min("off").alias("next_off"))
    bounds = first.join(second, KEYS, "left")
    after = F.when(F.col("first_open") < F.col("failed_off"), F.col("first_open")).otherwise(F.col("next_off"))
    return ledger.select(*KEYS, "off").join(F.broadcast(bounds.withColumn("bound", after)), KEYS).groupBy(*KEYS).agg(below(F.col("first_open")).alias("before"), below(F.col("bound")).alias("after"))


def register_violations(registrations: DataFrame) -> DataFrame:
    """(topic, part, off, times): offsets that were registered more than once."""
    return registrations.groupBy(*KEYS, "off").agg(F.count("*").alias("times")).where("times > 1")


def order_violations(registrations: DataFrame, seq: str = "seq") -> DataFrame:
    """Ordered mode: registrations whose offset doesn't exceed every one registered before in its partition."""
    # Within a partition the highest offset so far is a running maximum, carried by chunk.
    df = registrations.withColumn("__chunk", F.floor(F.col(seq) / (1 << 16)))
    tops = df.groupBy(*KEYS, "__chunk").agg(F.max("off").alias("__top"))
    earlier = W.partitionBy(*KEYS).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = tops.select(*KEYS, "__chunk", F.max("__top").over(earlier).alias("__carry"))
    within = W.partitionBy(*KEYS, "__chunk").orderBy(seq).rowsBetween(W.unboundedPreceding, -1)
    out = df.withColumn("__before", F.max("off").over(within)).join(carry, [*KEYS, "__chunk"])
    highest = F.greatest("__before", "__carry")
    return out.where(F.col("off") <= highest).select(*KEYS, "off", seq, highest.alias("highest"))


def expand_batches(batches: DataFrame) -> DataFrame:
    """One row for each offset of inclusive ranges, gaps included; empty ranges give none."""
    span = F.when(F.col("first_off") <= F.col("last_off"), F.sequence("first_off", "last_off"))
    return batches.withColumn("off", F.explode(span)).drop("first_off", "last_off")


def illegal_transitions(changes: DataFrame, seq: str = "seq") -> DataFrame:
    """Changes (topic, part, off, seq, status) that the state machine doesn't allow; each offset is ordered alone."""
    before = F.lag("status").over(W.partitionBy(*KEYS, "off").orderBy(seq))
    allowed = F.lit(False)
    for a, b in TRANSITIONS:
        allowed = allowed | ((F.col("was").isNull() if a is None else F.col("was").eqNullSafe(a)) & (F.col("status") == b))
    return changes.withColumn("was", before).where(~allowed).select(*KEYS, "off", seq, "was", "status")


def latest_status(changes: DataFrame, seq: str = "seq") -> DataFrame:
    return changes.groupBy(*KEYS, "off").agg(F.max_by("status", seq).alias("status"))


def abandoned(ledger: DataFrame, revoked: DataFrame) -> DataFrame:
    """Records of revoked partitions that aren't DONE, once each."""
    return ledger.join(revoked.distinct(), KEYS, "left_semi").where("status <> 'DONE'").select(*KEYS, "off", "status")


def retained(rows: DataFrame, partitions: DataFrame) -> DataFrame:
    return rows.join(partitions.distinct(), KEYS, "left_semi")


def queue_depth(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(*KEYS).agg(F.count_if(F.col("status") == "REGISTERED").alias("queued"))
