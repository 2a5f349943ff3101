"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Backoff, ErrorPolicy


def record_bytes(key: Column, value: Column) -> Column:
    """UTF-8 bytes of key and value; a null counts as none."""
    return (F.coalesce(F.octet_length(key), F.lit(0)) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def format_bytes(n: Column) -> Column:
    """1024-based, one decimal from KB on, rounded half up."""
    unit = lambda name, size: F.format_string(f"%.1f{name}", n / float(size))
    return F.when(n >= 1 << 30, unit("GB", 1 << 30)).when(n >= 1 << 20, unit("MB", 1 << 20)).when(n >= 1 << 10, unit("KB", 1 << 10)).otherwise(F.concat(n.cast("string"), F.lit("B")))


def backoff_ms(attempt: Column, policy: ErrorPolicy) -> Column:
    """The wait before an attempt; attempts up to 0, and a base of 0, wait the base."""
    base = F.lit(policy.base_ms).cast("long")
    if policy.backoff is Backoff.FIXED or not policy.base_ms:
        return F.when(attempt.isNotNull(), base)
    grown = base * F.pow(F.lit(2.0), F.least(attempt, F.lit(30))).cast("long")
    if policy.max_ms:
        grown = F.least(grown, F.lit(policy.max_ms).cast("long"))
    return F.when(attempt <= 0, base).otherwise(grown)
