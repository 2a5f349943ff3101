"""Running results over a long order without one task per key.

A plain window needs all rows of a key in one task. Here rows are cut into chunks of the ordering
number; each chunk is summed up before it moves, chunk results are carried over a far shorter
window, and rows meet their chunk's carry by a join. All results equal the plain window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 1 << 16


def _keys(keys: list[str]) -> list[str]:
    return keys or ["__all"]


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """df with, for each name, the sum of the column over rows up to and with this one. order[0] is a number."""
    df = df.withColumn("__all", F.lit(0)).withColumn("__chunk", F.floor(F.col(order[0]) / chunk))
    keys = _keys(keys)
    parts = df.groupBy(*keys, "__chunk").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    earlier = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = parts.select(*keys, "__chunk", *(F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in sums))
    within = W.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = df.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()}).join(carry, [*keys, "__chunk"])
    out = out.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums})
    return out.drop("__all", "__chunk", *(f"__{n}" for n in sums))


def numbered(df: DataFrame, keys: list[str], order: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """df with the row number within keys, from 0. order must be a number without ties."""
    return running_sums(df, keys, [order], {name: F.lit(1).cast("long")}, chunk).withColumn(name, F.col(name) - 1)


def last_known(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], chunk: int = CHUNK, before: bool = False) -> DataFrame:
    """df with each column's last non-null value up to this row (before: ahead of this row), null if there is none."""
    df = df.withColumn("__all", F.lit(0)).withColumn("__chunk", F.floor(F.col(order) / chunk))
    keys = _keys(keys)
    known = {n: F.max(F.when(c.isNotNull(), F.struct(F.col(order).alias("o"), c.alias("v")))) for n, c in values.items()}
    parts = df.groupBy(*keys, "__chunk").agg(*(x.alias(f"__{n}") for n, x in known.items()))
    earlier = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = parts.select(*keys, "__chunk", *(F.last(f"__{n}", ignorenulls=True).over(earlier)["v"].alias(f"__{n}") for n in values))
    within = W.partitionBy(*keys, "__chunk").orderBy(order).rowsBetween(W.unboundedPreceding, -1 if before else W.currentRow)
    out = df.withColumns({n: F.last(c, ignorenulls=True).over(within) for n, c in values.items()}).join(carry, [*keys, "__chunk"])
    out = out.withColumns({n: F.coalesce(n, f"__{n}") for n in values})
    return out.drop("__all", "__chunk", *(f"__{n}" for n in values))
