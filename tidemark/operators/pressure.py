"""Admission control: hysteresis sensors, the worst of them, and what is in flight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.scalars import format_bytes
from ..schema import PRESSURE
from .running import last_known, running_sums


def code(status: Column) -> Column:
    """0, 1, 2 from calm to worst."""
    return F.array_position(F.array(*map(F.lit, PRESSURE)), status).cast("int") - 1


def sensor(samples: DataFrame, order: str, value: str, limits: Thresholds, name: str = "status", keys: list[str] | None = None) -> DataFrame:
    """samples with the sensor's status.

    The latch is the last sample at or above high (on) or at or below low (off); a critical sample
    is CRITICAL whatever the latch says.
    """
    x = F.col(value)
    latch = F.when(x >= limits.high, 1).when(x <= limits.low, 0)
    out = last_known(samples, keys or [], order, {"__latch": latch})
    status = F.when(x >= limits.critical, "CRITICAL").when(F.col("__latch") == 1, "THROTTLE").otherwise("OK")
    return out.withColumn(name, status if limits.enabled else F.lit("OK")).drop("__latch")


def worst(*statuses: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PRESSURE)), F.greatest(*map(code, statuses), F.lit(0)) + 1)


def in_flight(deltas: DataFrame, order: list[str]) -> DataFrame:
    """deltas (records, bytes of either sign) with the gauges in_flight and in_flight_bytes."""
    return running_sums(deltas, [], order, {"in_flight": F.col("records"), "in_flight_bytes": F.col("bytes")})


def throttles(samples: DataFrame, order: str, status: str = "status") -> DataFrame:
    """Samples at which pressure begins: not OK, after OK or at the start."""
    out = last_known(samples, [], order, {"__was": F.col(status)}, before=True)
    return out.where((F.col(status) != "OK") & (F.coalesce("__was", F.lit("OK")) == "OK")).drop("__was")


def count_detail(x: Column, limits: Thresholds, status: Column) -> Column:
    return F.concat(x.cast("long").cast("string"), F.lit(f"/{int(limits.high)} in-flight"), F.when(status != "OK", " [throttled]").otherwise(""))


def bytes_detail(x: Column, limits: Thresholds, status: Column) -> Column:
    return F.concat(format_bytes(x), F.lit("/"), format_bytes(F.lit(int(limits.high))), F.when(status != "OK", " [throttled]").otherwise(""))


def ratio_detail(x: Column, limits: Thresholds, status: Column) -> Column:
    return F.concat(F.format_string("%.1f%%", x * 100.0), F.lit(f"/{limits.high * 100:.0f}% heap"), F.when(status != "OK", " [throttled]").otherwise(""))


def summary(details: dict[str, Column]) -> Column:
    inside = F.concat_ws(", ", *(F.concat(F.lit(f"{n}="), c) for n, c in details.items()))
    return F.concat(F.lit("backpressure{"), inside, F.lit("}"))
