"""Mixing sources to target weights along a time-varying curriculum.

Each source's share of the words of the mix follows its weight; a target stops at `passes` times the
source's words and the excess is shared anew by weight, which one sort of the sources by words per
weight solves exactly in integers.  Within a source, documents stand in the order of a hash of
their ids; document d of pass e demands the words from e * source_size + (words before d) on, and is
taken when its middle lies below the target.  The weight of a source at training time t in [0, 1] is
w * (1 + slope * (2t - 1)); its integral, the cumulative demand, is inverted in closed form to give
each taken document its training position, and rows leave range-sorted by position.

All sums are exact integers over all rows.  A source is split into `buckets` ranges of the hash:
sums by range are aggregated before they move, so that a source with a third of all rows is spread.

Defined results: null text has size 0; null sources are one source, last in order; sources without
words have target 0; an empty table gives no rows; equal rows are interchangeable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import free_name

#: A word, and the weights that sources take in turn.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
ADDED = ("size", "source_size", "target", "passes", "taken", "positions")


@dataclass(frozen=True)
class Mix:
    passes: int = 3
    slopes: tuple[float, ...] = (-0.5, 0.0, 0.5)  # for each of WEIGHTS: early, even, late
    buckets: int = 4096


def targets(sizes: DataFrame, config: Mix = Mix()) -> DataFrame:
    """(source_key, source, s) -> with w, target, slope. One row a source, so one task can sort them."""
    n = len(WEIGHTS)
    step = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (step % n + 1).cast("int"))
    slope = F.element_at(F.array(*map(F.lit, config.slopes)), (step % n + 1).cast("int"))
    scale = 1
    for w in WEIGHTS:
        scale *= w
    ratio = F.col("s") * F.element_at(F.array(*(F.lit(scale // w) for w in WEIGHTS)), (step % n + 1).cast("int"))
    by = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(W.currentRow, W.unboundedFollowing)
    cap = F.col("s") * config.passes
    out = sizes.withColumns({"w": weight, "slope": slope, "ratio": ratio})
    out = out.withColumns({"left": F.sum("s").over(W.partitionBy()) - F.coalesce(F.sum(cap).over(before), F.lit(0)), "weights": F.sum("w").over(rest)})
    capped = F.col("left") * F.col("w") > cap * F.col("weights")
    out = out.withColumn("capped", capped)
    # The first source that is not capped has what is left for all after it.
    left, weights = (F.first(F.when(~F.col("capped"), F.col(c)), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) for c in ("left", "weights"))
    share = F.col("w") * left / weights
    return out.withColumn("target", F.when(F.col("capped"), cap.cast("double")).otherwise(F.coalesce(share, F.lit(0.0)))).select("source_key", "s", "w", "slope", "target")


def mix(docs: DataFrame, config: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with size, source_size, target, passes (times taken), taken (words) and positions (one a pass)."""
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED))
    own, digest, bucket, upto, within, slope = (free_name(docs, x) for x in ("source", "digest", "bucket", "upto", "within", "slope"))
    marked = docs.withColumns({
        "size": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"),
        own: F.coalesce(F.concat(F.lit("s"), source), F.lit("n")),
        digest: F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))),
    }).withColumn(bucket, (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * config.buckets / F.lit(1 << 32)).cast("int"))
    parts = marked.groupBy(F.col(own).alias("source_key"), F.col(bucket).alias("bucket"), F.col(source).alias("source")).agg(F.sum("size").alias("s"))
    aims = targets(parts.groupBy("source_key", "source").agg(F.sum("s").alias("s")), config)
    earlier = F.coalesce(F.sum("s").over(W.partitionBy("source_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = parts.select("source_key", "bucket", earlier.alias("before"))
    plan = ranges.join(aims, "source_key").select(
        F.col("source_key").alias(own), F.col("bucket").alias(bucket), F.col("before").alias(upto), F.col("s").alias("source_size"), "target", F.col("slope").alias(slope)
    )
    line = W.partitionBy(own, bucket).orderBy(digest, key, "size").rowsBetween(W.unboundedPreceding, -1)
    out = marked.withColumn(within, F.coalesce(F.sum("size").over(line), F.lit(0))).join(plan, [own, bucket])
    starts = F.array(*(F.lit(e) * F.col("source_size") + F.col(upto) + F.col(within) for e in range(config.passes)))
    held = F.filter(starts, lambda x: (x * 2 + F.col("size")).cast("double") < F.col("target") * 2)

    def position(x):
        f, rest = (x * 2 + F.col("size")).cast("double") / (F.col("target") * 2), F.lit(1.0) - F.col(slope)
        return f * 2 / (rest + F.sqrt(rest * rest + F.col(slope) * 4 * f))

    out = out.withColumn("positions", F.transform(held, position))
    out = out.withColumn("passes", F.size("positions"))
    return out.withColumn("taken", F.col("size") * F.col("passes")).select(*docs.columns, *ADDED)


def ordered(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows in training order by first position; untaken ones last."""
    first = F.coalesce(F.try_element_at("positions", F.lit(1)), F.lit(2.0))
    return mixed.withColumn("position", first).repartitionByRange("position", key).sortWithinPartitions("position", key)


def expanded(mixed: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """The mix itself: one row for each pass that takes a document, in training order."""
    at = free_name(mixed, "position")
    rows = mixed.select(*columns, F.explode("positions").alias(at))
    return rows.repartitionByRange(at, key).sortWithinPartitions(at, key).select(*columns)
