"""Counters of a run and the snapshot of them."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field


@dataclass(frozen=True)
class PipelineMetrics:
    # Throughput
    records_processed: int = 0
    records_failed: int = 0
    records_skipped: int = 0
    poll_count: int = 0
    empty_poll_count: int = 0
    # Pressure
    in_flight_records: int = 0
    in_flight_bytes: int = 0
    backpressure_status: str = "OK"
    throttle_count: int = 0
    partition_lags: dict[tuple[str, int], int] = field(default_factory=dict)
    # Errors
    retry_attempts: int = 0
    dlq_successes: int = 0
    dlq_failures: int = 0
    partition_failures: int = 0
    commit_successes: int = 0
    commit_failures: int = 0
    # Rebalance
    rebalance_count: int = 0
    drain_timeouts: int = 0
    records_abandoned: int = 0
    assigned_partitions: frozenset[tuple[str, int]] = frozenset()


class Counters:
    """Those that the state of the partitions doesn't hold."""

    NAMES = ("poll_count", "empty_poll_count", "throttle_count", "commit_successes", "commit_failures", "rebalance_count", "drain_timeouts", "records_abandoned")

    def __init__(self):
        self._lock, self._n = threading.Lock(), dict.fromkeys(self.NAMES, 0)

    def add(self, name: str, n: int = 1) -> None:
        with self._lock:
            self._n[name] += n

    def values(self) -> dict[str, int]:
        with self._lock:
            return dict(self._n)


class Muted(Counters):
    """Counts nothing."""

    def add(self, name: str, n: int = 1) -> None:
        pass
