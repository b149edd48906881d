"""Drift of every window against the baseline and against the window before it."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import col, join_null_safe, same_keys
from tidemark.functions.stats import chi2_pvalue, ks_pvalue
from tidemark.functions.templates import render
from tidemark.operators.profile import GROUP
from tidemark.operators.running import group_id
from tidemark.session import materialize
from tidemark.spec import BASELINE, CONSECUTIVE, MonitorSpec

_SERIES = ["granularity", "model_version", "model_stage", "slice_key", "slice_value"]
_BASE_KEYS = ["model_version", "model_stage", "slice_key", "slice_value"]

# Fixed list: metrics whose difference (current - base) is reported.
DELTAS = [
    "count",
    "avg",
    "percent_null",
    "percent_zeros",
    "percent_distinct",
    "non_null_columns",
]


def window_pairs(analysis: DataFrame, by: Sequence[str] = (*_SERIES, "column_name")) -> DataFrame:
    """``by, window, window_cmp``: each window with the last existing one before it.

    The input is one row per group of the metric table, not the monitored data, so a
    window over the series is small.
    """
    seen = analysis.select(*by, "window").distinct()
    order = Window.partitionBy(*by).orderBy("window.start")
    return seen.withColumn("window_cmp", F.lag("window").over(order)).where(
        F.col("window_cmp").isNotNull()
    )


#: Value counts that one task compares.
CHUNK_ROWS = 500_000
_SIDES = ["_base", "_own", "_mine", "num", "n", "total"]
_CHUNKS = "base long, own long, mine boolean, chunk int, n long, most double, least double"


def _chunk_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inside one range of values: per base its rows, per current group its rows and the distances.

    Distances are between the two distribution functions as if both began with the range; what
    lies before shifts all of them alike.
    """
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    base, own, mine, num, n, total = (pa.Table.from_batches(batches)[c].to_numpy() for c in _SIDES)
    codes, groups = pd.factorize(own)
    order = np.argsort(num, kind="stable")
    order = order[np.argsort(codes[order].astype("int16" if len(groups) < 2**15 else "int64"), kind="stable")]
    num, n = num[order], n[order]
    ends = np.cumsum(np.bincount(codes))
    chunk, found, of_base, nothing = TaskContext.get().partitionId(), [], {}, (num[:0], np.zeros(1))
    firsts = order[np.r_[0, ends[:-1]]]
    # Bases come first.
    for k in np.argsort(mine[firsts], kind="stable"):
        at, j = firsts[k], ends[k]
        i, key = (ends[k - 1] if k else 0), int(base[at])
        values, upto = num[i:j], np.concatenate([[0], np.cumsum(n[i:j])])
        shares = upto / total[at]
        if not mine[at]:
            of_base[key] = values, shares
            found.append((key, None, False, chunk, int(upto[-1]), None, None))
            continue
        if key not in of_base:
            of_base[key] = nothing
            found.append((key, None, False, chunk, 0, None, None))
        others, theirs = of_base[key]
        sides = [
            shares[np.searchsorted(values, values, side)] - theirs[np.searchsorted(others, values, side)] for side in ("left", "right")
        ]
        most, least = max(s.max() for s in sides), min(s.min() for s in sides)
        found.append((key, int(own[at]), True, chunk, int(upto[-1]), float(most), float(least)))
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in _CHUNKS.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)


def ks_statistics(
    cur: DataFrame, base: DataFrame, base_keys: Sequence[str], cur_keys: Sequence[str]
) -> DataFrame:
    """Largest distance of two empirical distribution functions per ``cur_keys``.

    ``cur`` and ``base`` are written value counts (``num``, ``n``); ``cur_keys`` contains
    ``base_keys``.  Between two current values the current function is flat and the
    base one only grows, so looking at each current value from both sides finds the
    maximum; the base is never copied per window.

    Values are range-partitioned, each range is looked at on its own, and the shares before it
    are added to the largest and least distance in it, so that no value is moved twice.
    """
    of_cur = cur.groupBy(*cur_keys).agg(F.sum("n").alias("n_cur"))
    of_base = base.groupBy(group_id(base_keys).alias("_base")).agg(F.sum("n").alias("n_base"))
    of_cur = of_cur.select(group_id(base_keys).alias("_base"), group_id(cur_keys).alias("_own"), *cur_keys, "n_cur")
    # Metric-sized; once written, their size is known and the counts need not move.
    totals = materialize(of_cur.join(of_base, "_base").where("n_cur > 0 AND n_base > 0"), "totals")
    none = F.lit(0).cast("long")
    mine = cur.select(group_id(cur_keys).alias("_own"), F.lit(True).alias("_mine"), "num", "n").join(
        totals.select("_own", "_base", F.col("n_cur").alias("total")), "_own"
    )
    # A base's own number is another one than that of a current group with the same keys.
    others = base.select(group_id(base_keys).alias("_base"), F.lit(False).alias("_mine"), "num", "n").join(
        totals.select("_base", F.col("n_base").alias("total")).distinct(), "_base"
    ).withColumn("_own", F.xxhash64(F.lit("base"), "_base"))
    both = materialize(mine.select(*_SIDES).unionByName(others.select(*_SIDES)), "sides")
    chunks = max(1, math.ceil(both.count() / CHUNK_ROWS))
    ranged = both.repartitionByRange(chunks, "_base", "num")
    local = materialize(ranged.mapInArrow(_chunk_distances, _CHUNKS), "distances")
    return ks_of_ranges(local, totals, cur_keys)


def ks_of_ranges(local: DataFrame, totals: DataFrame, cur_keys: Sequence[str]) -> DataFrame:
    """The test per ``cur_keys`` from distances inside ranges of values, as ``_CHUNKS`` names them.

    ``totals`` has the rows of each group, ``n_cur``, and of its base, ``n_base``.
    """
    none = F.lit(0).cast("long")
    # A row per group and range.
    before = [Window.partitionBy(g).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1) for g in ("base", "own")]
    of_bases = local.where("NOT mine").select("base", "chunk", F.coalesce(F.sum("n").over(before[0]), none).alias("b"))
    of_own = local.where("mine").withColumn("a", F.coalesce(F.sum("n").over(before[1]), none))
    rows = of_own.join(of_bases, ["base", "chunk"]).join(totals, F.col("own") == F.col("_own"))
    shift = F.col("a") / F.col("n_cur") - F.col("b") / F.col("n_base")
    farthest = F.greatest(F.abs(shift + F.col("most")), F.abs(shift + F.col("least")))
    found = rows.groupBy(*[col(k) for k in cur_keys]).agg(
        F.max(farthest).alias("ks_statistic"), F.max("n_cur").alias("_n1"), F.max("n_base").alias("_n2")
    )
    pvalue = ks_pvalue(F.col("ks_statistic"), F.col("_n1"), F.col("_n2"))
    return found.withColumn("ks_pvalue", pvalue).drop("_n1", "_n2")


# Quantiles that stand for each side's sketch, and what the estimate may be off: their
# steps and the ranks of both sketches.
SKETCH_POINTS = 400
SKETCH_ERROR = 0.015


def sketch_ks(cur: Column, base: Column) -> Column:
    """Kolmogorov-Smirnov distance of two quantile sketches, from their quantiles.

    Both lists are run through in order; a value counts up on one side and down on the
    other, and the largest sum between two different values is the distance.
    """
    shares = F.array(*[F.lit((i + 0.5) / SKETCH_POINTS) for i in range(SKETCH_POINTS)])

    def steps(sketch: Column, sign: int) -> Column:
        quantiles = F.kll_sketch_get_quantile_double(sketch, shares)
        return F.transform(quantiles, lambda x: F.struct(x.alias("x"), F.lit(sign).alias("sign")))

    start = F.struct(F.lit(None).cast("double").alias("x"), F.lit(0).alias("sum"), F.lit(0).alias("most"))

    def run(state: Column, step: Column) -> Column:
        done = F.when(state["x"] != step["x"], F.greatest(state["most"], F.abs(state["sum"]))).otherwise(state["most"])
        return F.struct(step["x"].alias("x"), (state["sum"] + step["sign"]).alias("sum"), done.alias("most"))

    both = F.array_sort(F.concat(steps(cur, 1), steps(base, -1)))
    return F.aggregate(both, start, run, lambda s: s["most"] / F.lit(float(SKETCH_POINTS)))


def category_tests(
    cur: DataFrame,
    base: DataFrame,
    base_keys: Sequence[str],
    cur_keys: Sequence[str],
    pvalue: bool = True,
) -> DataFrame:
    """Chi-squared homogeneity test and total variation of category counts.

    Categories only the base has contribute through the base totals, so a left join
    from the current side is enough and the base is never copied per window.

    Counts of classes (``low`` and ``high`` are columns) give the test of the classes, whose
    statistic is never above that of the values, and bounds of the values' total variation:
    ``tv_distance`` from below, ``tv_distance_max`` from above.  A class contributes exactly
    where it is one value on both sides, or its values cannot meet; else at least the
    difference and at most the sum of both shares.
    """
    classes = "low" in cur.columns and "low" in base.columns
    ends = ["low", "high"] if classes else []
    n1 = cur.groupBy(*cur_keys).agg(F.sum("n").cast("double").alias("n1"))
    n2 = base.groupBy(*base_keys).agg(
        F.sum("n").cast("double").alias("n2"), F.count("*").alias("k2")
    )
    # Metric-sized; once written, their size is known and the counts need not move.
    totals = join_null_safe(n1, n2, base_keys)
    totals = materialize(totals.select(group_id(base_keys).alias("_base"), group_id(cur_keys).alias("_own"), *totals.columns), "totals")
    mine = cur.select(group_id(cur_keys).alias("_own"), "txt", "n", *ends).join(totals.select("_own", "_base", "n1", "n2"), "_own")
    base_n = base.select(group_id(base_keys).alias("_base"), "txt", F.col("n").alias("b"), *[F.col(e).alias(f"b_{e}") for e in ends])
    rows = mine.join(base_n, ["_base", "txt"], "left")
    a, b = F.col("n").cast("double"), F.coalesce(F.col("b"), F.lit(0)).cast("double")
    p, q = a / F.col("n1"), b / F.col("n2")
    least = most = F.abs(p - q)
    if classes:
        apart = F.col("b").isNull() | (F.col("high") < F.col("b_low")) | (F.col("low") > F.col("b_high"))
        one = (F.col("low") == F.col("b_high")) & (F.col("high") == F.col("b_low"))
        least = F.when(apart, p + q).otherwise(F.abs(p - q))
        most = F.when(one, F.abs(p - q)).otherwise(p + q)
    sums = rows.groupBy("_own").agg(
        F.count("*").alias("k1"),
        F.count("b").alias("common"),
        F.sum(b).alias("matched"),
        F.sum(a * a / (a + b)).alias("sa"),
        F.sum(b * b / (a + b)).alias("sb"),
        F.sum(least).alias("gap"),
        F.sum(most).alias("gap_max"),
    )
    only_base = F.col("n2") - F.col("matched")
    chi = (F.col("n1") + F.col("n2")) * (
        F.col("sa") / F.col("n1") + (F.col("sb") + only_base) / F.col("n2") - 1
    )
    dof = F.col("k1") + F.col("k2") - F.col("common") - 1
    out = sums.join(totals, "_own").select(
        *[col(k) for k in cur_keys],
        F.greatest(F.lit(0.0), chi).alias("chi_squared_statistic"),
        dof.alias("chi_squared_dof"),
        (0.5 * (F.col("gap") + only_base / F.col("n2"))).alias("tv_distance"),
        *([(0.5 * (F.col("gap_max") + only_base / F.col("n2"))).alias("tv_distance_max")] if classes else []),
    )
    if pvalue:
        p = chi2_pvalue(F.col("chi_squared_statistic"), F.col("chi_squared_dof").cast("double"))
        out = out.withColumn("chi_squared_pvalue", p)
    return out


def metric_deltas(pairs: DataFrame, spec: MonitorSpec) -> list[Column]:
    """Differences of paired metric rows ``cur`` and ``base``, built-in and custom."""

    def value(side: str, metric: str) -> Column:
        if metric == "percent_null":
            return F.col(f"{side}.num_nulls") / F.nullif(F.col(f"{side}.count"), F.lit(0))
        return F.col(f"{side}.{metric}")

    cols = [(value("cur", m) - value("base", m)).alias(f"{m}_delta") for m in DELTAS]
    for m in spec.metrics_of("drift"):
        text = render(m.metric_definition, current_df="cur", base_df="base")
        wanted = F.col("cur.column_name").isin(*m.input_columns)
        cols.append(F.when(wanted, F.expr(text).cast(m.output_type)).alias(m.metric_name))
    return cols


def select_pair(joined: DataFrame, kind: str, window_cmp: Column, spec: MonitorSpec) -> DataFrame:
    """Drift rows of paired metric rows: deltas and, with sketches, the KS test.

    The statistic of two sketches may be off by ``SKETCH_ERROR``; the p-value is that of the
    least distance it allows, so it is an upper bound however many rows there are.
    """
    out = joined.select(
        F.lit(kind).alias("drift_type"),
        *[F.col(f"cur.{k}") for k in GROUP],
        window_cmp.alias("window_cmp"),
        F.col("cur.column_name"),
        *metric_deltas(joined, spec),
        *([] if spec.exact else [F.struct(*[_sketched(side) for side in ("cur", "base")]).alias("_pair")]),
    )
    if spec.exact:
        return out
    n = [F.col(f"_pair.{side}.n") for side in ("cur", "base")]
    both = (n[0] > 0) & (n[1] > 0)
    distance = F.when(both, sketch_ks(F.col("_pair.cur.sketch"), F.col("_pair.base.sketch")))
    return out.withColumn("ks_statistic", distance).withColumn(
        "ks_pvalue", F.when(both, ks_pvalue(F.greatest(F.lit(0.0), F.col("ks_statistic") - SKETCH_ERROR), *n))
    ).drop("_pair")


def _sketched(side: str) -> Column:
    """Sketch of a metric row and the number of values in it; none for other columns."""
    n = F.when(F.col(f"{side}.sketch").isNotNull(), F.col(f"{side}.count") - F.col(f"{side}.num_nulls"))
    return F.struct(F.coalesce(n, F.lit(0)).alias("n"), F.col(f"{side}.sketch").alias("sketch")).alias(side)


def pair_with_baseline(analysis: DataFrame, base_analysis: DataFrame) -> DataFrame:
    """Metric rows ``cur`` next to the baseline row ``base`` of version and slice."""
    on = same_keys("cur", "base", [*_BASE_KEYS, "column_name"])
    return analysis.alias("cur").join(base_analysis.alias("base"), on)


def pair_with_previous(analysis: DataFrame) -> DataFrame:
    """Metric rows ``cur`` next to the row ``base`` of the window before."""
    by = [*_SERIES, "column_name"]
    cur = join_null_safe(analysis, window_pairs(analysis, by), [*by, "window"])
    on = same_keys("cur", "base", by) & (F.col("cur.window_cmp") == F.col("base.window"))
    return cur.alias("cur").join(analysis.alias("base"), on)


def previous_counts(counts: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Value counts of windows that have a predecessor, and the predecessors' counts
    labelled with the window they are compared to."""
    by = [*_SERIES, "column_name"]
    successor = pairs.select(*by, F.col("window_cmp").alias("window"), F.col("window").alias("_next"))
    base = join_null_safe(counts, successor, [*by, "window"]).drop("window")
    paired = join_null_safe(counts, pairs, [*by, "window"], "left_semi")
    return paired, base.withColumnRenamed("_next", "window")


def _with_distances(
    metrics: DataFrame, cur: DataFrame, base: DataFrame, base_keys: Sequence[str], exact: bool, pvalue: bool
) -> DataFrame:
    """Add the category tests and, if exact ones are asked for, the KS test."""
    keys = [*GROUP, "column_name"]
    is_number = F.col("num").isNotNull()
    parts = [ks_statistics(cur.where(is_number), base.where(is_number), base_keys, keys)] if exact else []
    parts.append(category_tests(cur.where(~is_number), base.where(~is_number), base_keys, keys, pvalue))
    for part in parts:
        metrics = join_null_safe(metrics, part, keys, "left")
    return metrics


def baseline_drift(
    analysis: DataFrame,
    counts: DataFrame,
    base_analysis: DataFrame,
    base_counts: DataFrame,
    spec: MonitorSpec,
    pvalue: bool = True,
) -> DataFrame:
    """Every window against the baseline of its version and slice."""
    none = F.lit(None).cast(analysis.schema["window"].dataType)
    metrics = select_pair(pair_with_baseline(analysis, base_analysis), BASELINE, none, spec)
    return _with_distances(metrics, counts, base_counts, [*_BASE_KEYS, "column_name"], spec.exact, pvalue)


def consecutive_drift(
    analysis: DataFrame, counts: DataFrame, spec: MonitorSpec, pvalue: bool = True
) -> DataFrame:
    """Every window against the one before it; the first has none."""
    joined = pair_with_previous(analysis)
    metrics = select_pair(joined, CONSECUTIVE, F.col("cur.window_cmp"), spec)
    # Written out, the few pairs have a known size and join without moving the counts.
    cur, base = previous_counts(counts, materialize(window_pairs(analysis), "pairs"))
    return _with_distances(metrics, cur, base, [*GROUP, "column_name"], spec.exact, pvalue)


def drift(
    analysis: DataFrame,
    counts: DataFrame,
    spec: MonitorSpec,
    base_analysis: DataFrame | None = None,
    base_counts: DataFrame | None = None,
    pvalue: bool = True,
) -> DataFrame:
    """BASELINE and CONSECUTIVE rows together."""
    rows = consecutive_drift(analysis, counts, spec, pvalue)
    if base_analysis is not None:
        rows = baseline_drift(
            analysis, counts, base_analysis, base_counts, spec, pvalue
        ).unionByName(rows)
    return rows
