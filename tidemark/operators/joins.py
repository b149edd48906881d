"""Enrichment joins, upserts and deletes on plain tables.

Joins are left to the engine: sides are broadcast only below its size limit, and a hot
key on the larger side is split at run time by the adaptive skew join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import col


class LeftJoin(NamedTuple):
    """One step of an enrichment chain: a table, the columns to keep, the key columns."""

    table: DataFrame | str
    columns: Sequence[str]
    keys: Sequence[str]


def join_chain(df: DataFrame, steps: Sequence[LeftJoin]) -> DataFrame:
    """Left-join the tables in order; each keeps its listed columns (keys included)."""

    def step(acc: DataFrame, s: LeftJoin) -> DataFrame:
        right = df.sparkSession.table(s.table) if isinstance(s.table, str) else s.table
        wanted = list(dict.fromkeys([*s.keys, *s.columns]))
        return acc.join(right.select(*[col(c) for c in wanted]), on=list(s.keys), how="left")

    return reduce(step, steps, df)


def keyed_semi_join(fact: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Fact rows whose key occurs among ``keys``, each once however often it occurs.

    The key set is made distinct first, so a key with a third of all events reaches the
    join as one row.
    """
    return fact.join(keys.select(*on).distinct(), list(on), "left_semi")


def duplicate_matches(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one source row would update in the target."""
    present = source.where(_all_present(keys))
    twice = present.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("n")).where("n > 1")
    return twice.join(target.select(*[col(k) for k in keys]), list(keys), "left_semi")


def _all_present(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [col(k).isNotNull() for k in keys])


def upsert(
    target: DataFrame, source: DataFrame, keys: Sequence[str], check: bool = True
) -> DataFrame:
    """Rows of ``source`` replace matching target rows; the others are added.

    NULL keys match nothing.  With ``check`` two source rows for one target row are an
    error, found by an aggregate over the keys only.
    """
    if check and not duplicate_matches(target, source, keys).isEmpty():
        raise ValueError(f"more than one source row matches a target row on {list(keys)}")
    kept = target.join(source.select(*[col(k) for k in keys]), list(keys), "left_anti")
    return kept.unionByName(source, allowMissingColumns=True).select(
        *target.columns, *[c for c in source.columns if c not in target.columns]
    )


def delete_where(df: DataFrame, predicate: str) -> DataFrame:
    """Rows left after a delete: a NULL predicate keeps its row."""
    return df.where(~F.coalesce(F.expr(predicate), F.lit(False)))


def conflicting_labels(labels: DataFrame, id_cols: Sequence[str], label_col: str) -> DataFrame:
    """Ids that are given more than one label."""
    given = labels.where(col(label_col).isNotNull()).groupBy(*[col(c) for c in id_cols])
    return given.agg(F.min(col(label_col)).alias("a"), F.max(col(label_col)).alias("b")).where("a != b")


def log_labels(
    logged: DataFrame, labels: DataFrame, id_cols: Sequence[str], label_col: str, only: str | None = None
) -> DataFrame:
    """Fill labels that arrive late; ids not in ``logged`` are ignored.

    An id may be given several times; of different labels the largest counts, a NULL label
    is none.  ``only`` is a condition on the rows that may get a label.  ``_updated`` marks
    the rows whose label changed.
    """
    given = labels.where(col(label_col).isNotNull()).groupBy(*[col(c) for c in id_cols])
    joined = logged.join(given.agg(F.max(col(label_col)).alias("_new")), list(id_cols), "left")
    old = col(label_col) if label_col in logged.columns else F.lit(None)
    wanted = F.col("_new").isNotNull() & (F.coalesce(F.expr(only), F.lit(False)) if only else F.lit(True))
    marked = joined.withColumn("_updated", wanted & ~old.eqNullSafe(F.col("_new")))
    return marked.withColumn(label_col, F.when(F.col("_updated"), F.col("_new")).otherwise(old)).drop("_new")


def updated_count(filled: DataFrame) -> DataFrame:
    return filled.agg(F.count_if("_updated").alias("updated"))
