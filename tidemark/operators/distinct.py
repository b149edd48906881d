"""Exact distinct counts that merge over windows, slices and batches.

Whole numbers are kept as bitmaps: a word of 64 neighbouring values and a bit for each that
occurs.  Words of the same neighbourhood merge by OR, on the map side first, so a dense column
takes a 64th of its values, and a sparse one no more rows than values.  Other numbers and texts
are kept as themselves.  Parts of disjoint or overlapping batches merge into the same rows, and
the count is the number of bits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)
_WORD = ["word", "num", "txt"]


def _cell(number: int, data_type: T.DataType, source: str) -> Column:
    """``(column, word, num, txt, bits)`` of a value; NULL for a NULL."""
    c = col(source)
    parts = {
        "word": F.lit(None).cast("long"), "num": F.lit(None).cast("double"), "txt": F.lit(None).cast("string"),
        "bits": F.lit(None).cast("long"),
    }
    if isinstance(data_type, _WHOLE):
        n = (F.unix_date(c) if isinstance(data_type, T.DateType) else c).cast("long")
        parts["word"] = F.shiftright(n, 6)
        parts["bits"] = F.call_function("shiftleft", F.lit(1).cast("long"), n.bitwiseAND(63).cast("int"))
    elif isinstance(data_type, (T.DoubleType, T.FloatType)):
        parts["num"] = c.cast("double")
    elif isinstance(data_type, T.BinaryType):
        parts["txt"] = F.base64(c)
    else:
        parts["txt"] = c.cast("string")
    return F.when(c.isNotNull(), F.struct(F.lit(number).alias("column"), *[v.alias(k) for k, v in parts.items()]))


def distinct_parts(
    rows: DataFrame, keys: Sequence[str], columns: Sequence[str], source: Callable[[str], str] = str
) -> DataFrame:
    """``keys, column_name, word, num, txt, bits``: what tells the values of every group apart."""
    types = {f.name: f.dataType for f in rows.schema.fields}
    cells = F.array(*[_cell(i, types[source(c)], source(c)) for i, c in enumerate(columns)])
    present = rows.select(*[col(k) for k in keys], F.explode(cells).alias("_cell")).where("_cell IS NOT NULL")
    # Columns go by number while values are told apart.
    by = [*keys, "column"]
    words = present.select(*[col(k) for k in keys], "_cell.*").groupBy(*map(col, by), *_WORD).agg(F.bit_or("bits").alias("bits"))
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("column")).alias("column_name")
    return words.select(*[col(k) for k in keys], name, *_WORD, "bits")


def merge_distinct_parts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts of several batches as one; rows already alone in their word stay as they are."""
    return parts.groupBy(*[col(k) for k in keys], "column_name", *_WORD).agg(F.bit_or("bits").alias("bits"))


def distinct_counts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, column_name, distinct_count`` of merged parts."""
    values = F.when(F.col("bits").isNotNull(), F.bit_count("bits")).otherwise(F.lit(1))
    return parts.groupBy(*[col(k) for k in keys], "column_name").agg(
        F.sum(values).cast("long").alias("distinct_count")
    )
