"""Schemas and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

LOG_SCHEMA = "topic string, part int, off long, k string, v string, ts timestamp"
LEDGER_SCHEMA = "topic string, part int, off long, k string, v string, bytes long, batch_id long, status string, resolution string, attempts int, last_error string"

#: An offset's states, a record's resolutions, and pressure from calm to worst.
STATUSES = ("REGISTERED", "IN_PROGRESS", "DONE", "FAILED")
RESOLUTIONS = ("SUCCESS", "HOOK_SKIP", "DLQ_SUCCESS", "SKIP", "FAIL_PARTITION", "HELD")
PRESSURE = ("OK", "THROTTLE", "CRITICAL")
#: The transitions that an offset may make; None is "not there yet".
TRANSITIONS = ((None, "REGISTERED"), ("REGISTERED", "IN_PROGRESS"), ("IN_PROGRESS", "DONE"), ("IN_PROGRESS", "FAILED"), ("FAILED", "DONE"))
WINDOW_LIMIT = 10_000


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
