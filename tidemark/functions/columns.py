"""Small helpers on column names, types and null-safe keys."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """Backtick-quote a column name so that hyphens and dots are safe."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def columns_of_type(df: DataFrame, kind: type[T.DataType]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kind)]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of_type(df, T.NumericType)


def string_columns(df: DataFrame) -> list[str]:
    return columns_of_type(df, T.StringType)


def null_safe_hash(columns: Sequence[Column]) -> Column:
    """64-bit hash that tells (x, NULL) from (NULL, x); the plain one skips NULLs."""
    flagged = [part for c in columns for part in (c.isNull(), c)]
    return F.xxhash64(*flagged)


def row_hash(df: DataFrame, names: Sequence[str] | None = None) -> Column:
    """64-bit hash of a row's values, each hashed together with its column's name.

    A NULL counts as nothing, so a column that was added and is still empty changes no
    hash, while a value that moves between columns does.  Nested values are hashed as JSON.
    """
    nested = (T.StructType, T.ArrayType, T.MapType)
    whole = F.lit(0).cast("long")
    for name in names if names is not None else df.columns:
        value = F.to_json(col(name)) if isinstance(df.schema[name].dataType, nested) else col(name)
        here = F.when(value.isNotNull(), F.xxhash64(F.lit(name), value)).otherwise(F.lit(0))
        whole = whole.bitwiseXOR(here)
    return F.xxhash64(whole)


def same_keys(left: str, right: str, keys: Iterable[str]) -> Column:
    """Null-safe equality of the named columns of two aliased frames."""
    parts = [F.col(f"{left}.{quoted(k)}").eqNullSafe(F.col(f"{right}.{quoted(k)}")) for k in keys]
    return reduce(lambda a, b: a & b, parts)


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which NULL keys match; the result carries the left keys once."""
    joined = left.alias("l").join(right.alias("r"), same_keys("l", "r", keys), how)
    if how in ("left_semi", "left_anti"):
        return joined
    kept = [F.col(f"r.{quoted(c)}") for c in right.columns if c not in keys]
    return joined.select(*[F.col(f"l.{quoted(c)}") for c in left.columns], *kept)
