"""Date helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def saturday_week_start(d: Column) -> Column:
    """The Saturday on or before ``d``."""
    return F.date_sub(F.next_day(d, "SAT"), 7)


def within_days(d: Column, days: int, as_of: Column | None = None) -> Column:
    """``d`` is no older than ``days`` before ``as_of`` (today unless given)."""
    today = F.current_date() if as_of is None else as_of
    return d.cast("date") >= F.date_sub(today, days)


def spread_dates(start: Column, index: Column, per_day: int) -> Column:
    """Day ``start + floor(index / per_day)``."""
    return F.date_add(start, F.floor(index / per_day).cast("int"))
