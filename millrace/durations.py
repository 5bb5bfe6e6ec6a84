"""Durations given as text ("15 minutes", "2 hours 30 seconds")."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_UNIT_MICROS = {
    "microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000,
    "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000,
}


def micros(text: str) -> int:
    """Length of a fixed duration in microseconds; months and years have none."""
    parts = re.findall(r"(-?\d+)\s*([a-z]+?)s?(?=\s|\d|$)", text.strip().lower())
    if not parts or any(unit not in _UNIT_MICROS for _, unit in parts):
        raise ValueError(f"not a fixed duration: {text!r}")
    return sum(int(n) * _UNIT_MICROS[unit] for n, unit in parts)


def interval(text: str) -> Column:
    """Day-time interval column."""
    return F.make_dt_interval(secs=F.lit(micros(text) / 1_000_000).cast("decimal(18,6)"))


def since_epoch(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp column with or without zone (session zone is UTC)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def at_micros(us: Column, like: str = "timestamp_ntz") -> Column:
    return F.timestamp_micros(us).cast(like)
