"""Value counts of many columns at once, in long form."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col
from tidemark.operators.running import GROUP_ID, named, running_by_group, value_at_rank


def value_struct(name: str, data_type: T.DataType, source: str | None = None, number: int | None = None) -> Column:
    """``(column_name, num, txt)``: numbers as double, anything else as text.

    With a ``number``, the column goes by that: ``(_column, num, txt)``.

    Longs and decimals carry their text too, since a double cannot tell every pair of
    them apart.  ``source`` is the name the column goes by, if it is another one.
    """
    c = col(source or name)
    none_num, none_txt = F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(data_type, (T.LongType, T.DecimalType)):
        num, txt = c.cast("double"), c.cast("string")
    elif isinstance(data_type, T.NumericType):
        num, txt = c.cast("double"), none_txt
    elif isinstance(data_type, T.BinaryType):
        num, txt = none_num, F.base64(c)
    else:
        num, txt = none_num, c.cast("string")
    named = F.lit(name).alias("column_name") if number is None else F.lit(number).alias("_column")
    return F.struct(named, num.alias("num"), txt.alias("txt"))


def long_values(
    rows: DataFrame, keys: Sequence[str], columns: Sequence[str], source: Callable[[str], str] = str
) -> DataFrame:
    """One row per input row and column: ``keys, column_name, num, txt``.

    ``source`` gives the name that a column goes by in ``rows``.
    """
    types = {f.name: f.dataType for f in rows.schema.fields}
    cells = F.array(*[value_struct(c, types[source(c)], source(c)) for c in columns])
    return rows.select(*keys, F.explode(cells).alias("_cell")).select(*keys, "_cell.*")


def _numbered_values(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], source: Callable[[str], str]) -> DataFrame:
    """Like ``long_values``, but columns go by number and NULLs are left out."""
    types = {f.name: f.dataType for f in rows.schema.fields}
    cells = F.array(*[value_struct(c, types[source(c)], source(c), i) for i, c in enumerate(columns)])
    values = rows.select(*keys, F.explode(cells).alias("_cell")).select(*keys, "_cell.*")
    return values.where(F.col("num").isNotNull() | F.col("txt").isNotNull())


def _column_name(columns: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in columns]), F.col("_column")).alias("column_name")


def value_counts(
    rows: DataFrame, keys: Sequence[str], columns: Sequence[str], source: Callable[[str], str] = str
) -> DataFrame:
    """Rows per (keys, column, value); NULLs are left out.

    Rows of one hot value are summed on the map side, so its group reaches the shuffle
    as one row per task.
    """
    present = _numbered_values(rows, keys, columns, source)
    counted = present.groupBy(*keys, "_column", "num", "txt").agg(F.count("*").alias("n"))
    return counted.select(*keys, _column_name(columns), "num", "txt", "n")


def value_counts_of_cells(rows: DataFrame, columns: Sequence[str], source: Callable[[str], str] = str) -> DataFrame:
    """``_gid, column_name, num, txt, n``: value counts of all groups named in the rows' ``_gids``.

    Rows of the same groups are a cell, and are counted before they are copied to their groups.
    """
    finest = _numbered_values(rows, ["_gids"], columns, source).groupBy("_gids", "_column", "num", "txt").agg(F.count("*").alias("n"))
    spread = finest.select(F.explode("_gids").alias("_gid"), "_column", "num", "txt", "n")
    counted = spread.groupBy("_gid", "_column", "num", "txt").agg(F.sum("n").alias("n"))
    return counted.select("_gid", _column_name(columns), "num", "txt", "n")


def _class_of(values: DataFrame, keys: Sequence[str], classes: int) -> DataFrame:
    """Counts, least and largest hash of every class of texts."""
    hashed = values.where(F.col("txt").isNotNull()).select(*keys, F.xxhash64("txt").alias("_hash"))
    of_class = F.pmod("_hash", F.lit(classes)).alias("_class")
    return hashed.groupBy(*keys, of_class).agg(F.count("*").alias("n"), F.min("_hash").alias("low"), F.max("_hash").alias("high"))


def _class_row(keys: Sequence[str], name: Column) -> list[Column]:
    """The columns of a class's count: ``txt`` is the class."""
    return [*[col(k) for k in keys], name, F.lit(None).cast("double").alias("num"), F.col("_class").cast("string").alias("txt"), F.col("n"), F.col("low"), F.col("high")]


def class_counts(
    rows: DataFrame, keys: Sequence[str], columns: Sequence[str], classes: int, source: Callable[[str], str] = str
) -> DataFrame:
    """Rows per (keys, column, class of values), however many values a column has.

    A value's class is its hash modulo ``classes``, the same in every table, so counts of
    different tables and days compare and add up.  ``low`` and ``high`` are the least and
    the largest hash in the class: where they agree the class holds one value.  Of texts
    only; ``txt`` is the class.
    """
    counted = _class_of(_numbered_values(rows, keys, columns, source), [*keys, "_column"], classes)
    return counted.select(*_class_row(keys, _column_name(columns)))


def class_counts_of_cells(
    rows: DataFrame,
    cell: Sequence[str],
    groups: Column,
    keys: Sequence[str],
    columns: Sequence[str],
    classes: int,
    source: Callable[[str], str] = str,
) -> DataFrame:
    """The same for all groups of the rows, an array of the ``keys`` that follows from the ``cell``.

    Rows alike in the ``cell`` are counted before they are copied to their groups.
    """
    finest = _class_of(_numbered_values(rows, cell, columns, source), [*cell, "_column"], classes)
    spread = finest.select(F.explode(groups).alias("_group"), "_column", "_class", "n", "low", "high")
    by = [*[F.col(f"_group.{k}").alias(k) for k in keys], F.col("_column"), F.col("_class")]
    counted = spread.groupBy(*by).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return counted.select(*_class_row(keys, _column_name(columns)))


def medians(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Discrete median of the numeric columns: the value at rank ceil(n/2)."""
    numbers = counts.where(F.col("num").isNotNull())
    half = F.ceil(F.col("n_total") / 2)
    return value_at_rank(numbers, [*keys, "column_name"], "num", "n", {"median": half})


def distinct_and_median(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both of the above, from one pass over written counts."""
    by = [*keys, "column_name"]
    running = running_by_group(counts, by, "num", ["n"], unordered=["txt"])
    found = running.groupBy(GROUP_ID).agg(
        F.count("*").alias("distinct_count"),
        F.min(F.when(F.col("n_running") >= F.ceil(F.col("n_total") / 2), F.col("num"))).alias("median"),
    )
    return named(found, counts, by)
