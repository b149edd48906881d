"""Monitoring jobs: full runs, incremental refresh and the mergeable aggregate base."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import col, join_null_safe, row_hash
from tidemark.operators.counts import long_values
from tidemark.operators.drift import drift, window_pairs
from tidemark.operators.profile import (
    GROUP,
    SKETCH_SIZE,
    add_derived_metrics,
    aggregate_metrics,
    analysed_columns,
    group_rows,
    group_value_counts,
    inner,
    moment_of,
)
from tidemark.operators.windows import assign_windows, name_windows, numbered_windows
from tidemark.plans.files import rows_of_windows
from tidemark.session import materialize
from tidemark.spec import BASELINE, CONSECUTIVE, INPUT, TABLE, MonitorSpec

_WINDOW = ["granularity", "window"]


class Stage(NamedTuple):
    """Metric rows and the value counts that drift needs, which are counted when it is asked for."""

    metrics: DataFrame
    counts: DataFrame | None


def aggregate_stage(
    df: DataFrame,
    spec: MonitorSpec,
    log_type: str = INPUT,
    as_of: dt.datetime | None = None,
    only_windows: DataFrame | None = None,
    counted: bool = True,
) -> Stage:
    """First step: everything that reads the monitored rows.

    The value counts of texts serve the category tests, with ``spec.exact`` those of numbers
    the exact KS test; the metrics do without them, so that they are left out unless ``counted``.
    """
    as_of = moment_of(spec, as_of)
    counts = group_value_counts(df, spec, log_type, as_of, only_windows) if counted else None
    return Stage(aggregate_metrics(df, spec, log_type, as_of, None, only_windows), counts)


def derived_stage(stage: Stage, spec: MonitorSpec) -> Stage:
    """Second step: row-wise expressions, no shuffle."""
    return Stage(add_derived_metrics(stage.metrics, spec), stage.counts)


def drift_stage(stage: Stage, spec: MonitorSpec, baseline: Stage | None = None) -> DataFrame:
    """Third step: every window against baseline and predecessor."""
    base = baseline or Stage(None, None)
    return drift(stage.metrics, materialize(stage.counts, "counts"), spec, base.metrics, base.counts)


def run_stages(
    df: DataFrame,
    spec: MonitorSpec,
    log_type: str = INPUT,
    as_of: dt.datetime | None = None,
    only_windows: DataFrame | None = None,
    counted: bool = True,
) -> Stage:
    """Both steps over the rows, the metrics written; of a baseline, the counts too."""
    stage = derived_stage(aggregate_stage(df, spec, log_type, as_of, only_windows, counted), spec)
    counts = materialize(stage.counts, "counts") if log_type == BASELINE and counted else stage.counts
    return Stage(materialize(stage.metrics, "metrics"), counts)


class MonitorResult(NamedTuple):
    analysis: DataFrame
    drift: DataFrame


def monitor(
    df: DataFrame,
    spec: MonitorSpec,
    baseline: DataFrame | None = None,
    as_of: dt.datetime | None = None,
) -> MonitorResult:
    """Both output tables of a full run."""
    scored = run_stages(df, spec, INPUT, as_of)
    if baseline is None:
        return MonitorResult(scored.metrics, drift_stage(scored, spec))
    base = run_stages(baseline, spec, BASELINE)
    return MonitorResult(
        scored.metrics.unionByName(base.metrics), drift_stage(scored, spec, base)
    )


# Change detection and incremental refresh ------------------------------------


def changed_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows whose number of copies differs between two snapshots, with ``_change``.

    One signed count over both sides: a single shuffle, summed on the map side first.  A
    column that one side lacks is NULL there.
    """
    both = new.withColumn("_sign", F.lit(1)).unionByName(old.withColumn("_sign", F.lit(-1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c != "_sign"]
    counted = both.groupBy(*[col(c) for c in cols]).agg(F.sum("_sign").alias("_change"))
    return counted.where(F.col("_change") != 0)


def watched_columns(df: DataFrame, spec: MonitorSpec) -> list[str]:
    """The columns that the metrics follow from; all, where the spec has free text."""
    if spec.slicing_exprs or spec.custom_metrics or spec.columns is None:
        return df.columns
    named = {*analysed_columns(df, spec), *(v for k, v in vars(spec.analysis).items() if k.endswith("_col"))}
    return [c for c in df.columns if c in named]


def window_marks(df: DataFrame, spec: MonitorSpec) -> DataFrame:
    """``granularity, window, rows, mark``: what tells whether a window's rows have changed.

    Sums of row hashes: each task adds up its rows, so nothing but the marks is shuffled.
    """
    placed = df.select(col(spec.timestamp_col), row_hash(df, watched_columns(df, spec)).alias("_hash"))
    hashes = numbered_windows(placed, spec.timestamp_col, spec.granularities)
    # The sum is too large for a long, those of three parts of the bits are not.
    bits, part = F.col("_hash"), F.lit(2**22 - 1)
    parts = [bits.bitwiseAND(part), F.shiftright(bits, 22).bitwiseAND(part), F.shiftright(bits, 44)]
    sums = hashes.groupBy("granularity", "_window").agg(F.count("*").alias("rows"), *[F.sum(p).alias(f"_{i}") for i, p in enumerate(parts)])
    whole = sum((F.col(f"_{i}").cast("decimal(38,0)") * F.lit(2 ** (22 * i)).cast("decimal(14,0)") for i in (1, 2)), F.col("_0"))
    return name_windows(sums, spec.granularities).select(*_WINDOW, "rows", whole.cast("decimal(38,0)").alias("mark"))


def moved_windows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Windows that two sets of marks differ in, new and vanished ones included."""
    marks = [df.select(*_WINDOW, "rows", "mark") for df in (old, new)]
    return changed_rows(*marks).select(*_WINDOW).distinct()


def touched_windows(changed: DataFrame, spec: MonitorSpec) -> DataFrame:
    """``granularity, window`` of every window holding a changed row."""
    return (
        assign_windows(changed.select(spec.timestamp_col), spec.timestamp_col, spec.granularities)
        .select(*_WINDOW)
        .distinct()
    )


SCAN_RANGES = 100


def scan_ranges(windows: DataFrame, most: int = SCAN_RANGES) -> list[tuple]:
    """The windows' time as at most ``most`` ranges; neighbours are joined beyond that.

    The input has a row per window, like the metric table.
    """
    times = windows.select(F.col("window.start").alias("a"), F.col("window.end").alias("b")).distinct()
    before = Window.orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    opens = times.withColumn("opens", F.coalesce(F.col("a") > F.max("b").over(before), F.lit(True)).cast("int"))
    island = F.sum("opens").over(Window.orderBy("a", "b"))
    merged = opens.withColumn("i", island).groupBy("i").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    size = F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy()) / F.lit(most)))
    joined = merged.withColumn("j", F.floor((F.col("i") - 1) / size)).groupBy("j")
    return [(r["a"], r["b"]) for r in joined.agg(F.min("a").alias("a"), F.max("b").alias("b")).collect()]


def _scan_bounds(df: DataFrame, spec: MonitorSpec, windows: DataFrame) -> DataFrame:
    """``df`` cut to the times of the windows, so that the scan can skip files."""
    ts, kind = col(spec.timestamp_col), df.schema[spec.timestamp_col].dataType
    inside = F.lit(False)
    for low, high in scan_ranges(windows):
        inside = inside | ((ts >= F.lit(low).cast(kind)) & (ts < F.lit(high).cast(kind)))
    return df.where(inside)


def refresh_analysis(
    df: DataFrame, spec: MonitorSpec, old: DataFrame, touched: DataFrame, files: DataFrame | None = None
) -> DataFrame:
    """The metric table after recomputing the touched windows only.

    Columns and metrics that are new are NULL in the windows that are not.  ``files`` are
    the windows of every file, where they are kept.
    """
    touched = materialize(touched, "touched")
    part = _scan_bounds(df if files is None else rows_of_windows(df, files, touched), spec, touched)
    fresh = run_stages(part, spec, only_windows=touched, counted=False).metrics
    return join_null_safe(old, touched, _WINDOW, "left_anti").unionByName(fresh, allowMissingColumns=True)


def refresh_drift(
    df: DataFrame,
    spec: MonitorSpec,
    old_drift: DataFrame,
    analysis: DataFrame,
    touched: DataFrame,
    baseline: Stage | None = None,
    files: DataFrame | None = None,
) -> DataFrame:
    """The drift table after an incremental refresh.

    Recomputed are the touched windows, the windows compared to one of them, and the
    windows whose predecessor changed.  ``analysis`` is the refreshed metric table.
    """
    scored = analysis.where(F.col("log_type") == INPUT)
    pairs = window_pairs(scored)
    by = [c for c in pairs.columns if c != "window_cmp"]
    was = old_drift.where(F.col("drift_type") == CONSECUTIVE).select(*by, "window_cmp")
    moved = join_null_safe(pairs, was, [*by, "window_cmp"], "left_anti").select(*_WINDOW)
    compared = pairs.select("granularity", F.col("window_cmp").alias("window"), F.col("window").alias("_w"))
    next_ones = (
        join_null_safe(compared, touched, _WINDOW, "left_semi")
        .select("granularity", F.col("_w").alias("window"))
    )
    affected = materialize(touched.unionByName(moved).unionByName(next_ones).distinct(), "affected")
    before = join_null_safe(pairs, affected, _WINDOW, "left_semi").select(
        "granularity", F.col("window_cmp").alias("window")
    )
    needed = materialize(affected.unionByName(before).distinct(), "needed")
    part = _scan_bounds(df if files is None else rows_of_windows(df, files, needed), spec, needed)
    counts = group_value_counts(part, spec, only_windows=needed)
    rows = Stage(join_null_safe(scored, needed, _WINDOW, "left_semi"), counts)
    fresh = join_null_safe(drift_stage(rows, spec, baseline), affected, _WINDOW, "left_semi")
    return join_null_safe(old_drift, affected, _WINDOW, "left_anti").unionByName(fresh, allowMissingColumns=True)


# Mergeable aggregates ---------------------------------------------------------


def aggregate_base(df: DataFrame, spec: MonitorSpec, columns: Sequence[str] | None = None) -> DataFrame:
    """Partial aggregates per group and column that later batches can be merged into."""
    columns = list(columns or analysed_columns(df, spec))
    cells = long_values(group_rows(df, spec), GROUP, columns, inner)
    present = F.col("num").isNotNull() | F.col("txt").isNotNull()
    return cells.groupBy(*GROUP, "column_name").agg(
        F.count("*").alias("n_rows"),
        F.count_if(present).alias("n_values"),
        F.count("num").alias("n_num"),
        F.sum("num").alias("total"),
        (F.var_pop("num") * F.count("num")).alias("m2"),
        F.min("num").alias("lowest"),
        F.max("num").alias("highest"),
        F.count_if(F.col("num") == 0).alias("n_zeros"),
        F.sum(F.when(F.col("num").isNull(), F.length("txt"))).alias("letters"),
        F.hll_sketch_agg(F.when(present, F.xxhash64("num", "txt"))).alias("hll"),
        F.kll_sketch_agg_double("num", SKETCH_SIZE).alias("kll"),
    )


def merge_aggregate_base(parts: DataFrame) -> DataFrame:
    """Merge partial aggregates of disjoint batches into one row per group and column.

    The spread of the parts' means is measured from the common mean, so large values do
    not cancel; the window holds as many rows as there are parts of a group.
    """
    n = F.nullif(F.col("n_num"), F.lit(0))
    group = Window.partitionBy(*GROUP, "column_name")
    common = F.sum("total").over(group) / F.nullif(F.sum("n_num").over(group), F.lit(0))
    off = F.col("total") / n - common
    parts = parts.withColumn("_between", F.coalesce(n * off * off, F.lit(0.0)))
    return parts.groupBy(*GROUP, "column_name").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_values").alias("n_values"),
        (F.sum("m2") + F.sum("_between")).alias("m2"),
        F.sum("n_num").alias("n_num"),
        F.sum("total").alias("total"),
        F.min("lowest").alias("lowest"),
        F.max("highest").alias("highest"),
        F.sum("n_zeros").alias("n_zeros"),
        F.sum("letters").alias("letters"),
        F.hll_union_agg("hll").alias("hll"),
        F.kll_merge_agg_double("kll").alias("kll"),
    )


def finish_aggregate_base(base: DataFrame) -> DataFrame:
    """Metrics from merged aggregates; distinct count and median are estimates.

    ``sketch`` is what drift needs, so windows can be compared without the data.
    """
    n = F.nullif(F.col("n_num"), F.lit(0))
    values = F.nullif(F.col("n_values"), F.lit(0))
    distinct = F.hll_sketch_estimate("hll")
    columns = base.select(
        *GROUP,
        "column_name",
        F.col("n_rows").alias("count"),
        (F.col("n_rows") - F.col("n_values")).alias("num_nulls"),
        F.col("lowest").alias("min"),
        F.col("highest").alias("max"),
        (F.col("total") / n).alias("avg"),
        F.when(
            F.col("n_num") > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("m2")) / (F.col("n_num") - 1))
        ).alias("stddev"),
        (F.col("n_zeros") / n).alias("percent_zeros"),
        (F.col("letters") / values).alias("avg_length"),
        distinct.alias("distinct_count"),
        (distinct / values).alias("percent_distinct"),
        F.when(F.col("n_num") > 0, F.kll_sketch_get_quantile_double("kll", F.lit(0.5))).alias("median"),
        F.when(F.col("n_num") > 0, F.col("kll")).alias("sketch"),
        F.lit(None).cast("bigint").alias("non_null_columns"),
    )
    tables = base.groupBy(*GROUP).agg(
        F.max("n_rows").alias("count"), F.count_if(F.col("n_values") > 0).alias("non_null_columns")
    )
    return columns.unionByName(tables.withColumn("column_name", F.lit(TABLE)), allowMissingColumns=True)
