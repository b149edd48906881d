"""Poisson bootstrap: replicate statistics in one scan."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import col
from tidemark.functions.draws import draw_bytes, poisson_draws, poisson_of, poisson_weights
from tidemark.operators.counts import value_struct
from tidemark.operators.drift import _CHUNKS, CHUNK_ROWS, ks_of_ranges
from tidemark.session import materialize

STATS = ("avg", "stddev", "percent_zeros", "avg_length", "percent_null")


def weighted_stat(stat: str, c: Column, w: Column, anchor: float | None = None) -> Column:
    """A statistic of ``c`` in which each row counts ``w`` times.

    Squares are taken from ``anchor``, a value near the mean, so large values do not cancel.
    """
    here = F.when(c.isNotNull(), w)
    n = F.nullif(F.sum(here).cast("double"), F.lit(0.0))
    if stat == "avg":
        return F.sum(w * c) / n
    if stat == "stddev":
        x = c.cast("double") - F.lit(anchor or 0.0)
        mean_square = F.sum(w * x) * F.sum(w * x) / n
        spread = F.greatest(F.lit(0.0), F.sum(w * x * x) - mean_square)
        return F.sqrt(spread / F.nullif(n - 1, F.lit(0.0)))
    if stat == "percent_zeros":
        return F.sum(F.when(c == 0, w).otherwise(0)) / n
    if stat == "avg_length":
        return F.sum(w * F.length(c)) / n
    if stat == "percent_null":
        return F.sum(F.when(c.isNull(), w).otherwise(0)) / F.nullif(
            F.sum(w).cast("double"), F.lit(0.0)
        )
    raise ValueError(f"no bootstrap for {stat!r}")


def anchors(df: DataFrame, column_stats: Mapping[str, Sequence[str]]) -> dict[str, float]:
    """Means of the columns whose spread is wanted: one row from one aggregate."""
    names = [c for c, stats in column_stats.items() if "stddev" in stats]
    if not names:
        return {}
    row = df.agg(*[F.avg(col(c)).cast("double").alias(f"a{i}") for i, c in enumerate(names)]).first()
    return {c: row[i] for i, c in enumerate(names)}


def bootstrap(
    df: DataFrame, column_stats: Mapping[str, Sequence[str]], replicates: int, key: Column
) -> DataFrame:
    """``replicate, column_name, metric, value`` without copying any row.

    Each task adds up its rows per replicate, so a shuffle carries one row per replicate
    and task however large the table is.
    """
    wanted = [(c, s) for c, stats in column_stats.items() for s in stats]
    anchor = anchors(df, column_stats)
    drawn = poisson_draws(df.select(*[col(c) for c in column_stats], key.alias("_k")), F.col("_k"), replicates)
    w = F.col("weight")
    wide = drawn.groupBy("replicate").agg(
        *[weighted_stat(s, col(c), w, anchor.get(c)).alias(f"s{i}") for i, (c, s) in enumerate(wanted)]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"), F.lit(s).alias("metric"), F.col(f"s{i}").alias("value")
            )
            for i, (c, s) in enumerate(wanted)
        ]
    )
    return wide.select("replicate", F.explode(cells).alias("_cell")).select("replicate", "_cell.*")


def bootstrap_by_copies(df: DataFrame, column: str, replicates: int, key: Column) -> DataFrame:
    """The same by repeating rows: the plain form the weighted one is checked against."""
    drawn = poisson_draws(df.select(col(column).alias("x"), key.alias("_k")), F.col("_k"), replicates)
    copies = drawn.select("replicate", "x", F.explode(F.array_repeat(F.lit(1), F.col("weight"))))
    return copies.groupBy("replicate").agg(
        F.count("x").alias("n"), F.avg("x").alias("avg"), F.stddev_samp("x").alias("stddev")
    )


#: Values whose counts a task adds up before it hands them on.
_HELD = 20_000
#: Rows of a range of values that one task resamples.
RANGE_ROWS = 250_000
_Batches = Iterator[pa.RecordBatch]


def _summed(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weights of each code added up; codes are 0, 1, ... in any order."""
    order = np.argsort(codes, kind="stable")
    starts = np.searchsorted(codes[order], np.arange(codes.max() + 1))
    return np.add.reduceat(weights[order], starts, axis=0, dtype="int64")


def _weighted_counts(replicates: int, columns: int) -> Callable[[_Batches], _Batches]:
    """Per task: the rows of each column and text (NULL: a number), and how often each replicate has them."""

    def packed(held: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        sums = np.array(list(held.values()), "int64")
        ends = pa.array(np.arange(len(held) + 1, dtype="int32") * replicates)
        weights = pa.ListArray.from_arrays(ends, pa.array(sums[:, 1:].ravel()))
        which, texts = zip(*held)
        arrays = [pa.array(which, pa.int32()), pa.array(texts, pa.string()), pa.array(sums[:, 0]), weights]
        return pa.RecordBatch.from_arrays(arrays, ["_column", "txt", "rows", "weights"])

    def run(batches: _Batches) -> _Batches:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            weights = poisson_weights(batch["_drawn"], replicates)
            weights = np.hstack([np.ones((len(weights), 1), "uint8"), weights])
            for i in range(columns):
                here = batch[f"_p{i}"].to_numpy(zero_copy_only=False)
                if not here.any():
                    continue
                texts = batch[f"_t{i}"].to_numpy(zero_copy_only=False)[here]
                codes, values = pd.factorize(texts, use_na_sentinel=False)
                for value, sums in zip(values, _summed(codes, weights[here])):
                    key = (i, value if isinstance(value, str) else None)
                    held[key] = held[key] + sums if key in held else sums
            if len(held) > _HELD:
                yield packed(held)
                held = {}
        if held:
            yield packed(held)

    return run


def replicate_counts(df: DataFrame, columns: Sequence[str], replicates: int, key: Column) -> DataFrame:
    """Weighted value counts per replicate and column, from one draw per row.

    ``replicate, column_name, txt, rows, n``: values of numbers are not told apart.  Each task adds up
    the counts of a value for all replicates at once.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    picked = [draw_bytes(key, replicates).alias("_drawn")]
    for i, c in enumerate(columns):
        value = value_struct(c, types[c])
        present = value["num"].isNotNull() | value["txt"].isNotNull()
        picked += [present.alias(f"_p{i}"), F.when(value["num"].isNull(), value["txt"]).alias(f"_t{i}")]
    schema = "_column int, txt string, rows long, weights array<long>"
    parts = df.select(*picked).mapInArrow(_weighted_counts(replicates, len(columns)), schema)
    each = parts.select("_column", "txt", "rows", F.posexplode("weights").alias("replicate", "n"))
    counted = each.groupBy("replicate", "_column", "txt").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"))
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("_column"))
    return counted.select("replicate", name.alias("column_name"), "txt", "rows", "n")


_RANGES = f"{_CHUNKS}, first double, last double, after double"


def _resampled_ranges(replicates: int, totals: dict[int, tuple[int, list[int]]]) -> Callable[[_Batches], _Batches]:
    """Inside one range of values: like ``_chunk_distances``, of every replicate and the rows themselves.

    Distances are taken after each value; after the last one, ``after``, only where the next
    range begins with another one.  ``totals`` are by column, of the rows and of the replicates.
    """

    def folded(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        num, weights = (np.concatenate(side) for side in zip(*parts))
        order = np.argsort(num, kind="stable")
        num, weights = num[order], weights[order]
        other = (num[1:] != num[:-1]) & ~(np.isnan(num[1:]) & np.isnan(num[:-1]))
        starts = np.flatnonzero(np.r_[True, other])
        return num[starts], np.add.reduceat(weights, starts, axis=0, dtype="int64")

    def run(batches: _Batches) -> _Batches:
        held: dict[int, list] = {}
        size = 0
        for batch in batches:
            weights = poisson_weights(batch["_drawn"], replicates)
            weights = np.hstack([np.ones((len(weights), 1), "uint8"), weights])
            which, num = batch["_column"].to_numpy(), batch["num"].to_numpy()
            for i in np.unique(which):
                held.setdefault(int(i), []).append((num[which == i], weights[which == i]))
            size += len(num)
            # Rows of a hot value become one.
            if size > 2 * RANGE_ROWS:
                held, size = {i: [folded(parts)] for i, parts in held.items()}, 0
        chunk, found = TaskContext.get().partitionId(), []
        for i, parts in held.items():
            num, weights = folded(parts)
            rows, of_replicates = totals[i]
            upto = np.cumsum(weights[:, 0])
            found.append((i, None, False, chunk, int(upto[-1]), None, None, None, None, None))
            for r, total in enumerate(of_replicates):
                if not total:
                    continue
                mine = np.cumsum(weights[:, r + 1])
                off = mine / total - upto / rows
                sides = (float(off[:-1].max()), float(off[:-1].min())) if len(off) > 1 else (None, None)
                ends = (float(num[0]), float(num[-1]), float(off[-1]))
                found.append((i, i * replicates + r, True, chunk, int(mine[-1]), *sides, *ends))
        if found:
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), *[pa.float64()] * 5]
            names = [c.split()[0] for c in _RANGES.split(", ")]
            arrays = [pa.array(c, t, from_pandas=False) for c, t in zip(zip(*found), types)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def replicate_ks(
    df: DataFrame, columns: Sequence[str], replicates: int, key: Column, counts: DataFrame
) -> DataFrame:
    """``replicate, column_name, ks_statistic`` of every replicate against the rows themselves.

    ``counts`` are the written ``replicate_counts`` of the columns, which are numbers.  A row moves
    once, to the range of its value, with its key: what the replicates draw is drawn there.
    """
    named = counts.where(F.col("column_name").isin(*columns)).select("column_name", "replicate", "rows", "n").collect()
    totals = {i: (0, [0] * replicates) for i in range(len(columns))}
    for r in named:
        i = columns.index(r["column_name"])
        totals[i][1][r["replicate"]] = r["n"]
        totals[i] = (r["rows"], totals[i][1])
    cells = F.array(*[F.struct(F.lit(i).alias("_column"), (col(c).cast("double") + 0.0).alias("num")) for i, c in enumerate(columns)])
    rows = df.select(key.alias("_k"), F.explode(cells).alias("_c")).select("_c.*", "_k").where("num IS NOT NULL")
    chunks = max(1, math.ceil(sum(n for n, _ in totals.values()) / RANGE_ROWS))
    drawn = rows.repartitionByRange(chunks, "_column", "num", "_k").select("_column", "num", draw_bytes(F.col("_k"), replicates).alias("_drawn"))
    local = materialize(drawn.mapInArrow(_resampled_ranges(replicates, totals), _RANGES), "distances")
    following = F.lead("first").over(Window.partitionBy("own").orderBy("chunk"))
    ended = following.isNull() | ~following.eqNullSafe(F.col("last"))
    after = F.when(F.col("mine") & ended, F.col("after"))
    local = local.select(
        "base", "own", "mine", "chunk", "n", F.greatest("most", after).alias("most"), F.least("least", after).alias("least")
    )
    of = [
        (i, i * replicates + r, columns[i], r, n, total)
        for i, (total, each) in totals.items()
        for r, n in enumerate(each)
        if n
    ]
    schema = "_base long, _own long, column_name string, replicate int, n_cur long, n_base long"
    return ks_of_ranges(local, df.sparkSession.createDataFrame(of, schema), ["replicate", "column_name"])


def resample_counts(counts: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """The same distribution from value counts instead of rows.

    The weights of n equal rows add up to one Poisson(n) draw, so the work depends on
    the number of distinct values and not on the number of rows.  A draw follows from the
    seed, the value and the number of the replicate; a hash serves two replicates.
    """
    value = F.coalesce("txt", F.col("num").cast("string"))
    blocks = F.transform(
        F.sequence(F.lit(0), F.lit((replicates - 1) // 2)),
        lambda b: F.md5(F.concat_ws("-", F.lit(str(seed)), "column_name", value, b.cast("string"))),
    )
    mean = F.col("n").cast("double")
    draws = F.flatten(F.transform(blocks, lambda h: F.array(poisson_of(mean, h, 0), poisson_of(mean, h, 1))))
    drawn = counts.select("column_name", "num", "txt", F.posexplode(F.slice(draws, 1, replicates)).alias("replicate", "n"))
    return drawn.where(F.col("n") > 0).select("replicate", "column_name", "num", "txt", "n")


def percentile_interval(
    replicates: DataFrame,
    confidence: float,
    count: int,
    keys: Sequence[str] = ("metric", "column_name"),
    one_sided: bool = False,
) -> DataFrame:
    """``keys, low, high`` by rank among the replicate values.

    Two-sided: (1-c)/2 of the replicates are cut off at each end.  One-sided: all of 1-c
    is cut off at the top and ``low`` is 0.  A group has one row per replicate.
    """
    share = (1 - confidence) if one_sided else (1 - confidence) / 2
    pad = math.floor(round(share * count, 9))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("value").asc_nulls_last()))
    ranked = replicates.where(F.col("value").isNotNull()).withColumn("_rank", rank)
    low = F.lit(0.0) if one_sided else F.min(F.when(F.col("_rank") == max(pad, 1), F.col("value")))
    return ranked.groupBy(*keys).agg(
        low.alias("low"),
        F.max(F.when(F.col("_rank") <= max(count - pad, 1), F.col("value"))).alias("high"),
    )
