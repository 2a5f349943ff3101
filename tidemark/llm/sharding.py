"""Sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id, hash of the row), so equal texts are neighbours: a group of them
has consecutive slots, and is cut only where a boundary between shards falls into it.  Each round counts,
over all partitions, the exact bytes and the key range of every gap between candidate boundaries;
the gaps that hold the wanted boundaries are probed anew until each splitter meets the tolerance.
Only then do rows move, once, to cells that are contiguous ranges of the order; a row's slot is the number of
rows in its shard's earlier cells and its rank in its own.  Between rounds the driver holds a few numbers per shard,
whatever the input's size.

Defined results: a null text has size 1 and counts as the empty one; null ids are the least; rows that agree in text
and doc_id are in one shard, ordered by a hash of all their columns (maps aside); a very long text moves as any
other and sets how near equal shards can be; an empty table gives no rows; columns of the input that clash with
added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

ADDED = ("size", "shard", "slot")


@dataclass(frozen=True)
class Sharding:
    shards: int = 16
    tolerance: float = 0.001  # of a shard's bytes
    probes: int = 7  # for each splitter and round
    cell_rows: int = 250_000  # rows numbered by one task, about


Key = tuple[int, int]
_HALF = 1 << 63


def _number(key: Key) -> int:
    return (key[0] + _HALF) << 64 | (key[1] + _HALF)


def _key(number: int) -> Key:
    return (number >> 64) - _HALF, (number & (2 * _HALF - 1)) - _HALF


def _place(cuts: list[Key], first: Column, second: Column) -> Column:
    """How many of the ascending cuts are at or below the key: a binary search as one expression."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        a, b = cuts[mid]
        reached = (first > F.lit(a)) | ((first == F.lit(a)) & (second >= F.lit(b)))
        return F.when(reached, search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(cuts))


def splitters(keys: DataFrame, config: Sharding) -> list[Key]:
    """Ascending keys at which shards 1, 2, ... begin. keys: columns h, i (longs) and size."""
    whole = keys.agg(F.sum("size").alias("size"), F.min(F.struct("h", "i")).alias("low"), F.max(F.struct("h", "i")).alias("high")).first()
    if whole["size"] is None:
        return []
    total, top = whole["size"], _number(tuple(whole["high"])) + 1
    wanted = {s: total * s / config.shards for s in range(1, config.shards)}
    room = max(1.0, config.tolerance * total / config.shards)
    span = {s: (_number(tuple(whole["low"])), top) for s in wanted}  # a boundary lies within
    best = {s: (wanted[s], span[s][0]) for s in wanted}
    for s in wanted:
        best[s] = min(best[s], (abs(total - wanted[s]), top))
    open_ = set(wanted)
    while open_:
        probes = sorted({lo + (hi - lo) * j // (config.probes + 1) for s in open_ for lo, hi in [span[s]] for j in range(1, config.probes + 1)} | {x for s in open_ for x in (span[s][0], span[s][1], span[s][1] + 1) if x < top})
        found = keys.groupBy(_place([_key(p) for p in probes], F.col("h"), F.col("i")).alias("gap")).agg(F.sum("size").alias("size"), F.min(F.struct("h", "i")).alias("low"), F.max(F.struct("h", "i")).alias("high")).collect()
        gaps, below = [], 0
        for r in sorted(found, key=lambda r: r["gap"]):
            gaps.append((below, below + r["size"], _number(tuple(r["low"])), _number(tuple(r["high"]))))
            below += r["size"]
        for s in sorted(open_):
            for under, upto, low, high in gaps:
                # A boundary at `low` leaves `under` bytes below it, one just after `high` leaves `upto`.
                best[s] = min(best[s], (abs(under - wanted[s]), low), (abs(upto - wanted[s]), high + 1))
                if under <= wanted[s] < upto:
                    span[s] = (low + 1, high)
            if best[s][0] <= room or span[s][0] > span[s][1]:
                open_.discard(s)
    return [_key(min(x, 2 * _HALF * 2 * _HALF - 1)) for x in sorted(best[s][1] for s in wanted)]


def _share(x: Column, low: Column, span: Column, parts: Column) -> Column:
    """Which of `parts` equal ranges x lies in; never falls as x grows."""
    place = F.floor((x.cast("double") - low.cast("double")) / span.cast("double") * parts)
    return F.least(F.greatest(place, F.lit(0)), parts - 1).cast("int")


def _whole(x: Column, parts: Column) -> Column:
    """The same over all longs."""
    return _share(x, F.lit(-(2.0**63)), F.lit(2.0**64), parts)


def _cells(keys: DataFrame, rows: int, config: Sharding) -> Callable[[DataFrame, str, str, str], DataFrame]:
    """A function that gives rows their cell (c, g, p): contiguous key ranges of about cell_rows rows, in the order of the keys.

    c parts the hashes evenly. Of a range with far more rows, each hash with many rows is a range of its own (g), parted
    by the ids, or by the tie breaker where all ids are equal (p).
    """
    cells = F.lit(max(8, rows // config.cell_rows + 1))
    most = 4 * config.cell_rows
    marked = keys.withColumn("c", _whole(F.col("h"), cells))
    large = [r["c"] for r in marked.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > most).collect()]  # at most rows / most
    hot = None
    if large:
        held = marked.where(F.col("c").isin(large)).groupBy("c", "h").agg(F.count("*").alias("n"), F.min("i").alias("low"), F.max("i").alias("high")).where(F.col("n") > most)
        hot = F.broadcast(held.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("h", "n", "low", "high"))).alias("hot")))

    def placed(df: DataFrame, h: str, i: str, t: str) -> DataFrame:
        df = df.withColumn("c", _whole(F.col(h), cells))
        if hot is None:
            return df.withColumns({"g": F.lit(0), "p": F.lit(0)})
        mine = F.get(F.filter("hot", lambda x: x["h"] == F.col(h)), 0)
        group = F.coalesce(2 * F.size(F.filter("hot", lambda x: x["h"] < F.col(h))) + mine.isNotNull().cast("int"), F.lit(0))
        parts = F.ceil(mine["n"] / config.cell_rows)
        by_id = _share(F.col(i), mine["low"], mine["high"].cast("double") - mine["low"].cast("double") + 1, parts)
        part = F.when(mine["low"] < mine["high"], by_id).otherwise(_whole(F.col(t), parts))
        return df.join(hot, "c", "left").withColumns({"g": group, "p": F.coalesce(part, F.lit(0))}).drop("hot")

    return placed


def shard(docs: DataFrame, config: Sharding = Sharding(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with size (UTF-8 bytes and 1), shard and slot (gapless from 0 in each shard, in the order of the keys)."""
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED))
    names = docs.columns
    held = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")  # so that no name can clash
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size")
    # A null key sorts as the least one.
    own = [F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.coalesce(F.col(key).cast("long"), F.lit(-_HALF)).alias("i"), F.xxhash64(*(F.col(f"`{c}`") for c in names if not isinstance(docs.schema[c].dataType, T.MapType))).alias("t"), size]
    keys = written(docs.select(*own), "shard-keys")
    cuts = splitters(keys, config)
    place = _cells(keys, keys.count(), config)
    cell = ["shard", "c", "g", "p"]

    def placed(df: DataFrame) -> DataFrame:
        return place(df.withColumn("shard", _place(cuts, F.col("h"), F.col("i")).cast("int")), "h", "i", "t")

    counts = placed(keys).groupBy(*cell).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("c", "g", "p").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(*cell, F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(W.partitionBy(*cell).orderBy("h", "i", "t"))
    out = placed(docs.select(held, *own)).withColumn("nth", nth).join(offsets, cell)
    return out.select(*(F.col("row")[c].alias(c) for c in names), "size", "shard", (F.col("nth") + F.col("before") - 1).cast("long").alias("slot"))
