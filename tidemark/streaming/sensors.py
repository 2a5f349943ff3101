"""Live pressure sensors and the controller that takes the worst of them."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import SparkSession

from ..config import Thresholds
from ..schema import PRESSURE

_UNITS = ((1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB"))


class PressureSensor(Protocol):
    """What a sensor of the user's own offers."""

    name: str

    def status(self) -> str: ...

    def detail(self) -> str: ...


class Sensor:
    """A hysteresis over readings: pressure begins at high and ends at low."""

    def __init__(self, limits: Thresholds, name: str = "sensor", read: Callable[[], float] | None = None, show: Callable[[float, Thresholds], str] = lambda x, t: f"{x:g}/{t.high:g}"):
        self.limits, self.name, self.read, self.show, self.latched = limits, name, read, show, False

    def judge(self, x: float) -> str:
        if not self.limits.enabled:
            return "OK"
        if x >= self.limits.critical:
            self.latched = True
            return "CRITICAL"
        self.latched = x > self.limits.low if self.latched else x >= self.limits.high
        return "THROTTLE" if self.latched else "OK"

    def status(self) -> str:
        return self.judge(self.read())

    def detail(self) -> str:
        return self.show(self.read(), self.limits) + (" [throttled]" if self.latched else "")


def size_text(n: float) -> str:
    for unit, name in _UNITS:
        if n >= unit:
            return f"{n / unit:.1f}{name}"
    return f"{int(n)}B"


def heap_ratio(spark: SparkSession) -> float:
    """Share of the driver's heap in use; 0 where no most is known."""
    usage = spark._jvm.java.lang.management.ManagementFactory.getMemoryMXBean().getHeapMemoryUsage()
    return usage.getUsed() / usage.getMax() if usage.getMax() > 0 else 0.0


def record_sensor(limits: Thresholds, read: Callable[[], float]) -> Sensor:
    return Sensor(limits, "records", read, lambda x, t: f"{int(x)}/{int(t.high)} in-flight")


def byte_sensor(limits: Thresholds, read: Callable[[], float]) -> Sensor:
    return Sensor(limits, "bytes", read, lambda x, t: f"{size_text(x)}/{size_text(t.high)}")


def heap_sensor(limits: Thresholds, read: Callable[[], float]) -> Sensor:
    return Sensor(limits, "heap", read, lambda x, t: f"{x * 100:.1f}%/{t.high * 100:.0f}% heap")


class Controller:
    """The worst of some sensors; a disabled one is always OK."""

    def __init__(self, sensors: list[PressureSensor], enabled: bool = True):
        self.sensors, self.enabled = sensors, enabled

    def evaluate(self) -> str:
        worst = "OK"
        for s in self.sensors if self.enabled else []:
            worst = max(worst, s.status(), key=PRESSURE.index)
            if worst == PRESSURE[-1]:
                break
        return worst

    def summary(self) -> str:
        if not self.enabled:
            return "backpressure=disabled"
        return "backpressure{" + ", ".join(f"{s.name}={s.detail()}" for s in self.sensors) + "}"
