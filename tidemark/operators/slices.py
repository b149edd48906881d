"""Independent slices: each row belongs to the whole and to one value per expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slice_pairs(exprs: Sequence[str]) -> list[tuple[Column, Column]]:
    """``(slice_key, slice_value)`` of the unsliced group and of every expression."""
    none = F.lit(None).cast("string")
    return [(none, none)] + [(F.lit(text), F.expr(text).cast("string")) for text in exprs]


def with_slices(df: DataFrame, exprs: Sequence[str]) -> DataFrame:
    pieces = [
        F.struct(key.alias("slice_key"), value.alias("slice_value"))
        for key, value in slice_pairs(exprs)
    ]
    return df.select("*", F.explode(F.array(*pieces)).alias("_slice")).select(
        *df.columns, "_slice.slice_key", "_slice.slice_value"
    )
