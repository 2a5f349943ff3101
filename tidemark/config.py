"""Configuration: plain frozen values, checked when they are made."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from typing import Any


class Fallback(Enum):
    SKIP = "SKIP"
    FAIL_PARTITION = "FAIL_PARTITION"


class ThreadMode(Enum):
    """PLATFORM: `concurrency` records of a partition at a time. VIRTUAL: as many as a poll holds."""

    PLATFORM = "PLATFORM"
    VIRTUAL = "VIRTUAL"


class Backoff(Enum):
    FIXED = "FIXED"
    EXPONENTIAL = "EXPONENTIAL"


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class ErrorPolicy:
    """Retry, then dead letters if there is a handler, then the fallback."""

    max_retries: int = 0
    base_ms: int = 1_000
    backoff: Backoff = Backoff.FIXED
    max_ms: int = 60_000  # 0: no cap
    dead_letter: Callable[[Any, str], None] | None = None
    fallback: Fallback = Fallback.FAIL_PARTITION

    def __post_init__(self) -> None:
        _need(self.max_retries >= 0, "max_retries must not be negative")
        _need(self.base_ms >= 0 and self.max_ms >= 0, "delays must not be negative")

    @classmethod
    def fail_fast(cls) -> ErrorPolicy:
        return cls()

    @classmethod
    def skip_on_error(cls) -> ErrorPolicy:
        return cls(fallback=Fallback.SKIP)

    def delay_ms(self, attempt: int) -> int:
        """Before attempt number `attempt`; the first retry is attempt 1 and already doubles the base."""
        if attempt <= 0 or not self.base_ms or self.backoff is Backoff.FIXED:
            return self.base_ms
        grown = self.base_ms << min(attempt, 30)
        return min(grown, self.max_ms) if self.max_ms else grown


@dataclass(frozen=True)
class Thresholds:
    """Hysteresis: pressure begins at high and ends at low; critical is worse than that."""

    low: float
    high: float
    critical: float
    enabled: bool = True

    def __post_init__(self) -> None:
        _need(0 <= self.low < self.high < self.critical, "thresholds must satisfy 0 <= low < high < critical")


def record_thresholds() -> Thresholds:
    return Thresholds(6_000, 10_000, 50_000)


def byte_thresholds() -> Thresholds:
    return Thresholds(128 << 20, 256 << 20, 512 << 20, enabled=False)


def heap_thresholds() -> Thresholds:
    return Thresholds(0.5, 0.7, 0.9, enabled=False)


@dataclass(frozen=True)
class PipelineConfig:
    """Exactly one of handler (per record) and batch_handler (per partition's batch) is given."""

    topics: tuple[str, ...]
    handler: Callable[[Any], None] | None = None
    batch_handler: Callable[[str, int, list], None] | None = None
    before: Callable[[Any], bool] | None = None
    after: Callable[[Any], None] | None = None
    on_error: Callable[[Any, int, Exception], None] | None = None
    errors: ErrorPolicy = field(default_factory=ErrorPolicy)
    records: Thresholds = field(default_factory=record_thresholds)
    bytes_: Thresholds = field(default_factory=byte_thresholds)
    heap: Thresholds = field(default_factory=heap_thresholds)
    sensors: tuple[Any, ...] = ()  # of status(), name and detail(), evaluated after the built-in ones
    commit: Callable[[dict[tuple[str, int], int]], None] | None = None  # takes the commit map; None: kept in the run's folder
    metrics: bool = True  # False: counts nothing
    threads: ThreadMode = ThreadMode.PLATFORM
    concurrency: int = 1
    commit_ms: int = 5_000
    drain_ms: int = 30_000
    shutdown_ms: int = 30_000
    poll_ms: int = 100
    batch_limit: int = 500  # records of a poll: what a batch handler gets at once
    restart_ms: int = 100  # before a query that failed is started anew
    max_restarts: int | None = None  # in a row without progress; None: no limit

    def __post_init__(self) -> None:
        _need(bool(self.topics) and all(t.strip() for t in self.topics), "topics must be named")
        _need((self.handler is None) != (self.batch_handler is None), "give a record handler or a batch handler, not both")
        _need(self.concurrency > 0 and self.batch_limit > 0, "concurrency and batch_limit must be positive")
        _need(min(self.commit_ms, self.poll_ms, self.drain_ms, self.shutdown_ms) > 0, "durations must be positive")
        _need(self.batch_handler is None or not (self.before or self.after or self.on_error), "hooks go with a record handler only")
