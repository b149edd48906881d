"""Tumbling windows of fixed or calendar length, several at once."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
_MONTHS = {"month": 1, "year": 12}
# The first Monday of the epoch: weeks start on Mondays, not on Thursdays.
_WEEK_SHIFT = 4 * 86400
_EPOCH_MONTHS = 1970 * 12


def parse_granularity(text: str) -> tuple[int, str]:
    match = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day|week|month|year)s?\s*", text.lower())
    if not match or int(match[1]) < 1:
        raise ValueError(f"not a granularity: {text!r}")
    return int(match[1]), match[2]


def window_number(ts: Column, granularity: str) -> Column:
    """A number for the bucket holding ``ts``: the micros or months from the epoch to its start.

    Cheaper for a row than the bucket itself, and enough to tell rows of different buckets apart.
    """
    n, unit = parse_granularity(granularity)
    ts = ts.cast("timestamp")
    if unit in _SECONDS:
        length = n * _SECONDS[unit] * 1_000_000
        shift = _WEEK_SHIFT * 1_000_000 if unit == "week" else 0
        micros = F.unix_micros(ts)
        return micros - F.pmod(micros - F.lit(shift), F.lit(length))
    day = ts.cast("date")
    index = F.year(day) * 12 + F.month(day) - 1
    return (index - F.pmod(index, F.lit(n * _MONTHS[unit])) - _EPOCH_MONTHS).cast("long")


def window_at(number: Column, granularity: str) -> Column:
    """``struct<start,end>`` of the bucket with the number."""
    n, unit = parse_granularity(granularity)
    if unit in _SECONDS:
        end = number + F.lit(n * _SECONDS[unit] * 1_000_000)
        return F.struct(F.timestamp_micros(number).alias("start"), F.timestamp_micros(end).alias("end"))
    first = F.add_months(F.lit(dt.date(1970, 1, 1)), number.cast("int"))
    return F.struct(
        first.cast("timestamp").alias("start"),
        F.add_months(first, n * _MONTHS[unit]).cast("timestamp").alias("end"),
    )


def window_of(ts: Column, granularity: str) -> Column:
    """``struct<start,end>`` of the bucket holding ``ts``, aligned in UTC."""
    return window_at(window_number(ts, granularity), granularity)


def snapshot_window(as_of: Column) -> Column:
    """The window of a table without time: the moment of its refresh."""
    return F.struct(as_of.cast("timestamp").alias("start"), as_of.cast("timestamp").alias("end"))


def no_window() -> Column:
    return F.lit(None).cast("struct<start:timestamp,end:timestamp>")


def numbered_windows(df: DataFrame, ts_col: str, granularities: Sequence[str]) -> DataFrame:
    """Like ``assign_windows``, with ``granularity`` and ``_window`` as numbers: ``name_windows`` names them."""
    ts = F.col(ts_col)
    numbers = [F.struct(F.lit(i).alias("granularity"), window_number(ts, g).alias("_window")) for i, g in enumerate(granularities)]
    rows = df.where(ts.isNotNull())
    if len(numbers) == 1:
        return rows.select(*df.columns, numbers[0]["granularity"].alias("granularity"), numbers[0]["_window"].alias("_window"))
    return rows.select("*", F.explode(F.array(*numbers)).alias("_bucket")).select(*df.columns, "_bucket.granularity", "_bucket._window")


def name_windows(df: DataFrame, granularities: Sequence[str]) -> DataFrame:
    """``granularity`` and ``window`` for the numbers of ``numbered_windows``."""
    kept = [c for c in df.columns if c not in ("granularity", "_window")]
    which, number = F.col("granularity"), F.col("_window")
    windows = F.coalesce(*[F.when(which == i, window_at(number, g)) for i, g in enumerate(granularities)])
    names = F.get(F.array(*[F.lit(g) for g in granularities]), which)
    return df.select(names.alias("granularity"), windows.alias("window"), *kept)


def assign_windows(df: DataFrame, ts_col: str, granularities: Sequence[str]) -> DataFrame:
    """Add ``granularity`` and ``window``; one output row per granularity.

    Rows without a timestamp belong to no window and are left out.
    """
    ts = F.col(ts_col)
    buckets = F.array(
        *[
            F.struct(F.lit(g).alias("granularity"), window_of(ts, g).alias("window"))
            for g in granularities
        ]
    )
    return (
        df.where(ts.isNotNull())
        .select("*", F.explode(buckets).alias("_bucket"))
        .select(*df.columns, "_bucket.granularity", "_bucket.window")
    )
