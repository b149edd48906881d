"""Running totals over groups of any size, by one plan.

Rows are range-partitioned by (group, value) into chunks, each chunk is summed on its own,
and the totals of the chunks before it are added: a group holding a third of all rows is
spread over as many tasks as there are chunks, and small inputs are one chunk.  A group is
known by a 64-bit number meanwhile; its key columns, a small table, are joined back at the
end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import col, null_safe_hash
from tidemark.session import materialize

CHUNK = "_chunk"
GROUP_ID = "_gid"


def group_id(keys: Sequence[str]) -> Column:
    """64-bit number of a group; without keys there is one group."""
    return null_safe_hash([col(k) for k in keys]) if keys else F.lit(0).cast("long")


def group_table(df: DataFrame, keys: Sequence[str], name: str = GROUP_ID) -> DataFrame:
    """The number and the key columns of every group: as large as the metric table."""
    groups = df.select(group_id(keys).alias(name), *[col(k) for k in keys]).distinct()
    return materialize(groups, "groups")


def chunked(df: DataFrame, *order: str) -> DataFrame:
    """Range-partition by the columns and record the partition as a column.

    Rows equal in all of them stay together.  The result is written out because the range
    bounds come from a sample: all readers must see the same chunks.  It is read back with
    one task per chunk, so windows and sums within chunks need no further shuffle.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order])
    parts = materialize(ranged.withColumn(CHUNK, F.spark_partition_id()), "chunks")
    return parts.repartition(CHUNK)


def chunk_offsets(parts: DataFrame, group: str, measures: Sequence[str]) -> DataFrame:
    """Per (group, chunk): each measure before the chunk and over the whole group.

    A row per group and chunk; written, so that its size is known to the join.
    """
    sums = parts.groupBy(group, CHUNK).agg(*[F.sum(m).alias(m) for m in measures])
    whole = Window.partitionBy(group)
    before = whole.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return materialize(
        sums.select(
            group,
            CHUNK,
            *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"{m}_before") for m in measures],
            *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures],
        ),
        "offsets",
    )


def within_chunk(group: str, order_col: str, measure: str) -> Column:
    """Sum up to and including all rows with the same value, inside one chunk."""
    order = Window.partitionBy(group, CHUNK).orderBy(order_col)
    return F.sum(measure).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))


def running_by_group(
    df: DataFrame, keys: Sequence[str], order_col: str, measures: Sequence[str], unordered: Sequence[str] = ()
) -> DataFrame:
    """``_gid``, order column, measures, ``<m>_running`` (peers included), ``<m>_total``.

    ``unordered`` names further value columns of rows whose ``order_col`` is NULL, so
    that these are spread over chunks too; such rows get no meaningful running total.
    """
    narrow = df.select(group_id(keys).alias(GROUP_ID), order_col, *unordered, *measures)
    parts = chunked(narrow, GROUP_ID, order_col, *unordered)
    sums = parts.withColumns({f"{m}_running": within_chunk(GROUP_ID, order_col, m) for m in measures})
    joined = sums.join(chunk_offsets(parts, GROUP_ID, measures), [GROUP_ID, CHUNK])
    joined = joined.withColumns({f"{m}_running": F.col(f"{m}_running") + F.col(f"{m}_before") for m in measures})
    return joined.drop(CHUNK, *[f"{m}_before" for m in measures])


def named(rows: DataFrame, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows by group number with the key columns of the groups of ``df``."""
    if not keys:
        return rows.drop(GROUP_ID)
    rest = [c for c in rows.columns if c != GROUP_ID]
    return rows.join(group_table(df, keys), GROUP_ID).select(*[col(k) for k in keys], *[col(c) for c in rest])


def running_totals(df: DataFrame, keys: Sequence[str], order_col: str, measures: Sequence[str]) -> DataFrame:
    """``keys``, order column, measures, running totals and group totals.

    ``df`` is read three times; pass a written table where that is dear.
    """
    return named(running_by_group(df, keys, order_col, measures), df, keys)


def value_at_rank(
    counts: DataFrame, keys: Sequence[str], value_col: str, count_col: str, ranks: dict[str, Column]
) -> DataFrame:
    """Order statistics from value counts.

    ``ranks`` maps an output column to a 1-based rank, which may refer to the group size
    as ``<count_col>_total``.
    """
    running = running_by_group(counts, keys, value_col, [count_col])
    reached = F.col(f"{count_col}_running")
    found = running.groupBy(GROUP_ID).agg(
        *[F.min(F.when(reached >= rank, F.col(value_col))).alias(name) for name, rank in ranks.items()]
    )
    return named(found, counts, keys)


def positions(df: DataFrame, order: Sequence[Column], to: str = "position") -> DataFrame:
    """All rows with their place in a sort: placed in their chunk, plus the rows before it."""
    ranged = df.repartitionByRange(*order)
    parts = materialize(ranged.withColumn(CHUNK, F.spark_partition_id()), "chunks").repartition(CHUNK)
    sizes = parts.groupBy(CHUNK).agg(F.count("*").alias("_size"))
    # A row per chunk.
    before = F.sum("_size").over(Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1))
    offsets = materialize(sizes.select(CHUNK, F.coalesce(before, F.lit(0)).alias("_before")), "offsets")
    here = F.row_number().over(Window.partitionBy(CHUNK).orderBy(*order))
    return parts.withColumn("_here", here).join(offsets, CHUNK).withColumn(
        to, F.col("_here") + F.col("_before")
    ).drop(CHUNK, "_here", "_before")
