"""Wide interval columns to one row per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import col, quoted


def stack_intervals(wide: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``<c>_low, <c>_high`` to ``column_name, low, high`` by ``stack``."""

    def text(name: str) -> str:
        return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"

    cells = ", ".join(f"{text(c)}, {quoted(c + '_low')}, {quoted(c + '_high')}" for c in columns)
    return wide.select(
        *[col(k) for k in keep], F.expr(f"stack({len(columns)}, {cells}) as (column_name, low, high)")
    )


def explode_intervals(wide: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The same by exploding an array of structs."""
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                col(f"{c}_low").alias("low"),
                col(f"{c}_high").alias("high"),
            )
            for c in columns
        ]
    )
    kept = [col(k) for k in keep]
    return wide.select(*kept, F.explode(cells).alias("_c")).select(*kept, "_c.*")
