"""Exact order statistics by selection: a sketch bounds where the rank lies, a second pass looks there.

The first pass has a quantile sketch of every column in every group, whose values a little below
and above the wanted share bound the value searched.  The second pass counts the values below the
lower bound and keeps those between the bounds, a few hundredths of all; only these are summed up
by value and ordered.  The rank tells whether the bounds held; where they did not, which the
sketch's error makes rare, the column is looked at again without bounds, so the result is exact
whatever the sketch says.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import col, join_null_safe
from tidemark.operators.running import GROUP_ID, group_id, running_by_group
from tidemark.session import materialize

#: Size of the sketches, and what their ranks are off by at most nearly always.
SELECT_SIZE = 400
ERROR = 0.015
GRID = 200
#: Stands for every value below the bounds; NaN is above all values.
_BELOW, _ABOVE = float("-inf"), float("nan")
_PLACE = ["_group", "column"]


def quantile_grid(sketch: str) -> Column:
    """Quantiles of a sketch at ``GRID + 1`` shares; NULL of an empty one.

    The function takes constant shares only, so bounds are picked from a grid of them.
    """
    shares = ", ".join(f"{i / GRID}D" for i in range(GRID + 1))
    return F.expr(f"if(kll_sketch_get_n_double({sketch}) > 0, kll_sketch_get_quantile_double({sketch}, array({shares})), null)")


def bounds(grid: Column, rank: Column, n: Column, error: float) -> Column:
    """``struct<low,high>`` that the value of the rank lies between; open without a grid."""
    share = rank / n
    below = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share - error)) * GRID).cast("int")
    above = F.ceil(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share + error)) * GRID).cast("int")
    low, high = F.coalesce(F.get(grid, below), F.lit(_BELOW)), F.coalesce(F.get(grid, above), F.lit(_ABOVE))
    return F.struct(low.alias("low"), high.alias("high"))


#: Rank of the discrete median among n values.
MEDIAN = {"median": lambda n: F.ceil(n / 2)}


def group_sketches(
    rows: DataFrame, keys: Sequence[str], columns: Sequence[str], source: Callable[[str], str] = str
) -> DataFrame:
    """First pass: ``_group``, the keys, and for each column the number of its values and their sketch."""
    aggs = []
    for i, c in enumerate(columns):
        value = col(source(c)).cast("double")
        aggs += [F.count(value).alias(f"n{i}"), F.kll_sketch_agg_double(value, SELECT_SIZE).alias(f"k{i}")]
    wide = rows.groupBy(*[col(k) for k in keys]).agg(*aggs)
    return materialize(wide.withColumn("_group", F.monotonically_increasing_id()), "sketches")


def order_statistics(
    rows: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    ranks: Mapping[str, Callable[[Column], Column]] = MEDIAN,
    source: Callable[[str], str] = str,
    sketched: DataFrame | None = None,
    error: float = ERROR,
) -> DataFrame:
    """``keys, column_name`` and, for each of ``ranks``, the value at that rank, exactly.

    A rank, from 1, follows from the number of values.  A column without values in a group has
    no row.  NaN counts as the greatest value.  ``sketched`` is the written result of
    ``group_sketches``, where it is at hand.
    """
    columns, names = list(columns), list(ranks)
    wide = group_sketches(rows, keys, columns, source) if sketched is None else sketched
    here = ["_group", *keys]
    grids = [quantile_grid(f"k{i}").alias(f"k{i}") for i in range(len(columns))]
    gridded = wide.select(*map(col, here), *[f"n{i}" for i in range(len(columns))], *grids)
    each = []
    for i in range(len(columns)):
        n = F.col(f"n{i}")
        for j, name in enumerate(names):
            rank = ranks[name](n).cast("long")
            at = F.when(n > 0, bounds(F.col(f"k{i}"), rank, n, error))
            each.append(F.struct(F.lit(i * len(names) + j).alias("column"), F.when(n > 0, rank).alias("rank"), at.alias("at")))
    places = gridded.select("_group", *[col(k) for k in keys], F.explode(F.array(*each)).alias("_c"))
    wanted = places.select("_group", *[col(k) for k in keys], "_c.*").where("rank IS NOT NULL")
    wanted = materialize(wanted, "bounds")
    values = [col(source(c)).cast("double") for c in columns for _ in names]
    found = materialize(_selected(rows, keys, values, wanted), "selected")
    missed = wanted.join(found.select(*_PLACE), _PLACE, "left_anti")
    if not missed.isEmpty():
        whole = F.struct(F.lit(_BELOW).alias("low"), F.lit(_ABOVE).alias("high"))
        again = materialize(missed.withColumn("at", whole), "bounds")
        found = found.unionByName(_selected(rows, keys, values, again))
    which = F.get(F.array(*[F.lit(c) for c in columns]), F.floor(F.col("column") / F.lit(len(names))).cast("int"))
    named = found.select("_group", which.alias("column_name"), (F.col("column") % len(names)).alias("_j"), "value")
    side = [F.max(F.when(F.col("_j") == j, F.col("value"))).alias(name) for j, name in enumerate(names)]
    groups = wide.select("_group", *[col(k) for k in keys])
    return groups.join(named.groupBy("_group", "column_name").agg(*side), "_group").drop("_group")


def _selected(rows: DataFrame, keys: Sequence[str], values: list[Column], wanted: DataFrame) -> DataFrame:
    """Second pass: ``_group, column, value`` where the bounds held."""
    # A row for each group, with the bounds of its columns side by side.
    sides = wanted.groupBy("_group", *[col(k) for k in keys]).agg(
        *[F.max(F.when(F.col("column") == i, F.col("at"))).alias(f"_at{i}") for i in range(len(values))]
    )
    sides = materialize(sides, "bounds")
    joined = join_null_safe(rows, sides, keys) if keys else rows.join(sides)
    cells = []
    for i, value in enumerate(values):
        at = F.col(f"_at{i}")
        near = F.struct(F.lit(i).alias("column"), F.when(value < at["low"], F.lit(_BELOW)).otherwise(value).alias("value"))
        cells.append(F.when(value <= at["high"], near))
    kept = joined.select("_group", F.explode(F.array(*cells)).alias("_c")).where("_c IS NOT NULL")
    # Hot values, and all values below, are one row a task.
    counts = kept.groupBy("_group", "_c.column", "_c.value").agg(F.count("*").alias("n"))
    running = running_by_group(materialize(counts, "near"), _PLACE, "value", ["n"])
    ranks = wanted.select(group_id(_PLACE).alias(GROUP_ID), *_PLACE, "rank", F.col("at.low").alias("low"))
    reached = running.join(ranks, GROUP_ID).where("n_running >= rank")
    first = reached.groupBy(*_PLACE).agg(F.min("value").alias("value"), F.first("low").alias("low"))
    held = (F.col("value") > F.lit(_BELOW)) | (F.col("low") == F.lit(_BELOW))
    return first.where(held).select(*_PLACE, "value")
