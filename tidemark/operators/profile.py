"""Profile metrics per column, window, slice and model version, in long form."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col, join_null_safe, null_safe_hash, numeric_columns, quoted
from tidemark.functions.templates import render
from tidemark.operators.counts import class_counts_of_cells, distinct_and_median, value_counts_of_cells
from tidemark.operators.packed import bucket_sizes, distinct_of_packed, medians_of_packed, packed, packed_kinds
from tidemark.operators.quality import quality_metrics
from tidemark.operators.running import group_id
from tidemark.operators.selection import order_statistics
from tidemark.operators.slices import slice_pairs
from tidemark.operators.windows import no_window, snapshot_window, window_at, window_number, window_of
from tidemark.session import materialize
from tidemark.spec import ALL_STAGES, BASELINE, INPUT, TABLE, InferenceLog, MonitorSpec

GROUP = ["granularity", "window", "model_version", "model_stage", "slice_key", "slice_value"]

_BASE_METRICS = {
    "count": "bigint",
    "num_nulls": "bigint",
    "min": "double",
    "max": "double",
    "avg": "double",
    "stddev": "double",
    "percent_zeros": "double",
    "avg_length": "double",
    "non_null_columns": "bigint",
}
_SKETCH_METRICS = {"distinct_count": "bigint", "median": "double", "sketch": "binary"}
# Size of a quantile sketch: ranks are off by less than 0.4 % with 99 % confidence.
SKETCH_SIZE = 800


def analysed_columns(df: DataFrame, spec: MonitorSpec) -> list[str]:
    """The columns to profile: all but those that only place a row."""
    if spec.columns is not None:
        return list(spec.columns)
    a = spec.analysis
    skipped = {spec.timestamp_col}
    if isinstance(a, InferenceLog):
        skipped |= {a.example_id_col, a.model_version_col, a.model_stage_col}
    return [c for c in df.columns if c not in skipped]


def inner(name: str) -> str:
    """Name of a monitored column among the grouped rows, apart from the group's own."""
    return f"_col_{name}" if name in GROUP or name.startswith("_") else name


def _inner_col(name: str) -> Column:
    return col(inner(name))


def _optional(name: str | None) -> Column:
    return col(name).cast("string") if name else F.lit(None).cast("string")


def _log_columns(spec: MonitorSpec) -> list[str]:
    """Prediction and label of an inference log."""
    a = spec.analysis
    return [c for c in (a.prediction_col, a.label_col) if c] if isinstance(a, InferenceLog) else []


class Placed(NamedTuple):
    """Rows with what places them (``_w<i>``, ``_s<i>``, version, stage), and their groups.

    A group is the values of ``GROUP``; ``kept`` are the columns that the rows have besides.
    """

    rows: DataFrame
    once: list[str]
    groups: list[tuple[Column, ...]]
    kept: list[str]

    def array(self) -> Column:
        """The groups of a row as one array, so that a single generator expands it."""
        return F.array(*[F.struct(*[v.alias(k) for k, v in zip(GROUP, g)]) for g in self.groups])

    def numbers(self) -> Column:
        """The same as numbers, each the ``group_id`` of its group."""
        return F.array(*[null_safe_hash(g) for g in self.groups])


def _placed(
    df: DataFrame, spec: MonitorSpec, log_type: str, as_of: dt.datetime | None, numbered: bool = False
) -> Placed:
    """With ``numbered``, windows go by number until the groups are asked for."""
    a = spec.analysis
    ts = spec.timestamp_col
    stage = getattr(a, "model_stage_col", None)
    if log_type == BASELINE:
        windows = [(F.lit(None).cast("string"), no_window())]
    elif ts is None:
        moment = F.lit(as_of) if as_of is not None else F.current_timestamp()
        windows = [(F.lit(None).cast("string"), snapshot_window(moment))]
    else:
        windows = [(F.lit(g), (window_number if numbered else window_of)(col(ts), g)) for g in spec.granularities]
        df = df.where(col(ts).isNotNull())
    kept = analysed_columns(df, spec)
    kept += [c for c in _log_columns(spec) if c not in kept]
    for metric in spec.metrics_of("aggregate"):
        if TABLE in metric.input_columns:  # free text: any column may be named in it
            kept = kept + [c for c in df.columns if c not in kept]
    # Computed once per row, below the generator, which then only copies references.
    pieces = slice_pairs(spec.slicing_exprs)
    once = {f"_w{i}": w for i, (_, w) in enumerate(windows)}
    once |= {f"_s{i}": value for i, (_, value) in enumerate(pieces)}
    once["_version"] = _optional(getattr(a, "model_version_col", None))
    once["_stage"] = _optional(stage)
    stages = [F.col("_stage")] + ([F.lit(ALL_STAGES)] if stage else [])
    places = [F.col(f"_w{i}") for i in range(len(windows))]
    if numbered and log_type != BASELINE and ts is not None:
        places = [window_at(w, g) for w, g in zip(places, spec.granularities)]
    groups = [
        (g, places[i], F.col("_version"), s, key, F.col(f"_s{j}"))
        for i, (g, _) in enumerate(windows)
        for s in stages
        for j, (key, _) in enumerate(pieces)
    ]
    rows = df.select(*[col(c).alias(inner(c)) for c in kept], *[e.alias(n) for n, e in once.items()])
    return Placed(rows, list(once), groups, kept)


def group_rows(
    df: DataFrame,
    spec: MonitorSpec,
    log_type: str = INPUT,
    as_of: dt.datetime | None = None,
    only_windows: DataFrame | None = None,
) -> DataFrame:
    """Rows tagged with every group they belong to.

    Granularities, stages and slices are crossed into one array, so a row is expanded by
    a single generator.  Columns go by their ``inner`` names.  Baseline rows have no window.  ``only_windows``
    (``granularity, window``) keeps the rows of those windows.
    """
    placed = _placed(df, spec, log_type, as_of)
    values = [_inner_col(c) for c in placed.kept]
    tagged = placed.rows.select(*values, F.explode(placed.array()).alias("_group"))
    rows = tagged.select(*[F.col(f"_group.{k}").alias(k) for k in GROUP], *values)
    if only_windows is not None:
        rows = join_null_safe(rows, only_windows, ["granularity", "window"], "left_semi")
    return rows


def cell_rows(
    df: DataFrame,
    spec: MonitorSpec,
    log_type: str = INPUT,
    as_of: dt.datetime | None = None,
    only_windows: DataFrame | None = None,
) -> DataFrame:
    """Rows with the numbers of their groups, ``_gids``, instead of a copy for each group.

    What merges is summed up by cell, the rows of the same groups, and copied to the groups
    afterwards.
    """
    placed = _placed(df, spec, log_type, as_of)
    values, rows = [_inner_col(c) for c in placed.kept], placed.rows
    if only_windows is not None and len(spec.granularities) > 1:
        rows = group_rows(df, spec, log_type, as_of, only_windows)
        return rows.select(*values, F.array(group_id(GROUP)).alias("_gids"))
    if only_windows is not None:
        of_window = rows.select("*", placed.groups[0][0].alias("granularity"), F.col("_w0").alias("window"))
        rows = join_null_safe(of_window, only_windows, ["granularity", "window"], "left_semi")
    return rows.select(*values, placed.numbers().alias("_gids"))


def group_list(
    df: DataFrame,
    spec: MonitorSpec,
    log_type: str = INPUT,
    as_of: dt.datetime | None = None,
    only_windows: DataFrame | None = None,
) -> DataFrame:
    """``_gid`` and the columns of every group of the rows, written: as large as the metric table."""
    placed = _placed(df, spec, log_type, as_of)
    cells = placed.rows.select(*placed.once).distinct()
    groups = cells.select(F.explode(placed.array()).alias("_group")).select("_group.*").distinct()
    if only_windows is not None:
        groups = join_null_safe(groups, only_windows, ["granularity", "window"], "left_semi")
    return materialize(groups.select(group_id(GROUP).alias("_gid"), *GROUP), "groups")


def _column_aggregates(name: str, data_type: T.DataType, exact: bool) -> dict[str, Column]:
    c = _inner_col(name)
    out: dict[str, Column] = {"count": F.count("*"), "num_nulls": F.count_if(c.isNull())}
    if isinstance(data_type, T.NumericType):
        out["min"] = F.min(c).cast("double")
        out["max"] = F.max(c).cast("double")
        out["avg"] = F.avg(c).cast("double")
        out["stddev"] = F.stddev_samp(c.cast("double"))
        present = F.count(c)
        out["percent_zeros"] = F.when(present > 0, F.count_if(c == 0) / present)
        if not exact:
            out["sketch"] = F.kll_sketch_agg_double(c.cast("double"), SKETCH_SIZE)
            out["median"] = F.when(present > 0, F.kll_sketch_get_quantile_double(out["sketch"], F.lit(0.5)))
    elif isinstance(data_type, T.StringType):
        out["avg_length"] = F.avg(F.length(c))
    if not exact:
        out["distinct_count"] = F.approx_count_distinct(c, 0.02)
    return out


def wide_aggregates(
    rows: DataFrame, spec: MonitorSpec, columns: list[str]
) -> tuple[DataFrame, dict[str, dict[str, str]], dict[str, str]]:
    """One aggregate over all columns.

    Returns the frame, the metric-to-column map per profiled column, and metric types.
    """
    named = {f.name: f.dataType for f in rows.schema.fields}
    types = {c: named[inner(c)] for c in columns}
    metric_types = dict(_BASE_METRICS)
    if not spec.exact:
        metric_types |= _SKETCH_METRICS
    placed: dict[str, dict[str, str]] = {TABLE: {"count": "t__count", "non_null_columns": "t__filled"}}
    aggs = [F.count("*").alias("t__count")]
    filled = sum((F.when(F.count(_inner_col(c)) > 0, 1).otherwise(0) for c in columns), F.lit(0))
    aggs.append(filled.alias("t__filled"))
    of_log = {c: named[inner(c)] for c in _log_columns(spec)}
    for name, expr in quality_metrics(spec.analysis, of_log, _inner_col).items():
        metric_types[name] = "double"
        placed[TABLE][name] = f"t__{name}"
        aggs.append(expr.alias(f"t__{name}"))
    for i, c in enumerate(columns):
        placed[c] = {}
        for metric, expr in _column_aggregates(c, types[c], spec.exact).items():
            placed[c][metric] = f"c{i}__{metric}"
            aggs.append(expr.alias(placed[c][metric]))
    for k, m in enumerate(spec.metrics_of("aggregate")):
        metric_types[m.metric_name] = m.output_type
        for c in m.input_columns:
            text = render(m.metric_definition, column_name=c if c == TABLE else inner(c))
            placed.setdefault(c, {})[m.metric_name] = f"m{k}__{len(aggs)}"
            aggs.append(F.expr(text).cast(m.output_type).alias(placed[c][m.metric_name]))
    return rows.groupBy(*GROUP).agg(*aggs), placed, metric_types


#: Types whose metrics are summed up by cell; sums of decimals would change their scale.
_MERGING = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
    T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType,
)
#: Cells that are summed up, at most, for each group.
CELLS_PER_GROUP = 4


def by_cells(placed: Placed, spec: MonitorSpec, types: Sequence[T.DataType]) -> bool:
    """Whether metrics are summed up by cell, the rows of the same groups, and then merged.

    That updates every sum and sketch once a row, not once for each group of the row.  What the user or
    the quality of a model adds does not merge.  The values of several slices multiply to cells
    but add up to groups, so that then the cells are counted first.
    """
    added = spec.metrics_of("aggregate") or _log_columns(spec)
    if added or len(placed.groups) == 1 or not all(isinstance(t, _MERGING) for t in types):
        return False
    if len(spec.slicing_exprs) < 2:
        return True
    cells = placed.rows.select(*placed.once).distinct().select(F.explode(placed.numbers()).alias("_gid"))
    copies, groups = cells.agg(F.count("*"), F.approx_count_distinct("_gid")).first()
    return copies <= CELLS_PER_GROUP * len(placed.groups) * groups


def _partial_aggregates(i: int, name: str, data_type: T.DataType, exact: bool) -> list[Column]:
    """What the metrics of a column are merged from, of a cell; without sketches if ``exact``."""
    c = _inner_col(name)
    aggs = {"n": F.count(c)} | ({} if exact else {"hll": F.hll_sketch_agg(F.col(f"_h{i}"))})
    if isinstance(data_type, T.NumericType):
        value = c.cast("double")
        aggs |= {
            "low": F.min(c), "high": F.max(c), "total": F.sum(value), "spread": F.var_pop(value) * F.count(c),
            "zeros": F.count_if(c == 0),
        }
        aggs |= {} if exact else {"kll": F.kll_sketch_agg_double(value, SKETCH_SIZE)}
    elif isinstance(data_type, T.StringType):
        aggs["total"] = F.sum(F.length(c).cast("double"))
    return [e.alias(f"p{i}__{k}") for k, e in aggs.items()]


def _spread(cells: Column, i: int, mean: Column) -> Column:
    """Squared distances from the mean, summed up over cells: inside them, and of their own means.

    The mean is known, so large values do not cancel.
    """

    def add(total: Column, cell: Column) -> Column:
        n = cell[f"p{i}__n"]
        off = cell[f"p{i}__total"] / F.nullif(n, F.lit(0)) - mean
        return total + F.coalesce(cell[f"p{i}__spread"] + n * off * off, F.lit(0.0))

    return F.greatest(F.lit(0.0), F.aggregate(cells, F.lit(0.0), add))


def merged_aggregates(
    placed: Placed, columns: list[str], types: Sequence[T.DataType], only_windows: DataFrame | None, exact: bool
) -> tuple[DataFrame, dict[str, dict[str, str]], dict[str, str]]:
    """The same as ``wide_aggregates`` without added metrics, merged from cells.

    Distinct counts are estimated by sketches that merge, of about the same error.
    """
    partial = [e for i, (c, t) in enumerate(zip(columns, types)) for e in _partial_aggregates(i, c, t, exact)]
    # Hashed in a step of its own, which is compiled; sketches evaluate what they are given row by row.
    hashes = {f"_h{i}": F.when(_inner_col(c).isNotNull(), F.xxhash64(_inner_col(c))) for i, c in enumerate(columns)}
    cells = (placed.rows if exact else placed.rows.withColumns(hashes)).groupBy(*placed.once).agg(F.count("*").alias("n_rows"), *partial)
    values = [c for c in cells.columns if c not in placed.once]
    spread = cells.select(F.explode(placed.array()).alias("_group"), *values)
    spread = spread.select(*[F.col(f"_group.{k}").alias(k) for k in GROUP], *values)
    if only_windows is not None:
        spread = join_null_safe(spread, only_windows, ["granularity", "window"], "left_semi")
    numbers = [i for i, t in enumerate(types) if isinstance(t, T.NumericType)]
    merges = {"n": F.sum, "low": F.min, "high": F.max, "total": F.sum, "zeros": F.sum, "hll": F.hll_union_agg, "kll": F.kll_merge_agg_double}
    aggs = [F.sum("n_rows").alias("n_rows")]
    aggs += [merges[k](v).alias(v) for v in values for k in [v.split("__")[-1]] if k in merges]
    # Three numbers a cell and column.
    moments = [F.col(f"p{i}__{k}") for i in numbers for k in ("n", "total", "spread")]
    aggs += [F.collect_list(F.struct(*moments)).alias("_cells")] if moments else []
    merged = spread.groupBy(*GROUP).agg(*aggs)
    named: dict[str, dict[str, str]] = {TABLE: {"count": "t__count", "non_null_columns": "t__filled"}}
    filled = sum((F.when(F.col(f"p{i}__n") > 0, 1).otherwise(0) for i in range(len(columns))), F.lit(0))
    out = [F.col("n_rows").alias("t__count"), filled.alias("t__filled")]
    for i, (c, t) in enumerate(zip(columns, types)):
        n, part = F.col(f"p{i}__n"), {k: F.col(f"p{i}__{k}") for k in ("low", "high", "total", "zeros")}
        mean = part["total"] / F.nullif(n, F.lit(0))
        metrics = {"count": F.col("n_rows"), "num_nulls": F.col("n_rows") - n}
        if not exact:
            metrics["distinct_count"] = F.hll_sketch_estimate(f"p{i}__hll")
        if i in numbers:
            metrics |= {
                "min": part["low"].cast("double"), "max": part["high"].cast("double"), "avg": mean,
                "stddev": F.when(n > 1, F.sqrt(_spread(F.col("_cells"), i, mean) / (n - 1))),
                "percent_zeros": part["zeros"] / F.nullif(n, F.lit(0)),
            }
            if not exact:
                median = F.kll_sketch_get_quantile_double(f"p{i}__kll", F.lit(0.5))
                metrics |= {"sketch": F.col(f"p{i}__kll"), "median": F.when(n > 0, median)}
        elif isinstance(t, T.StringType):
            metrics["avg_length"] = mean
        named[c] = {m: f"c{i}__{m}" for m in metrics}
        out += [e.alias(f"c{i}__{m}") for m, e in metrics.items()]
    return merged.select(*GROUP, *out), named, _BASE_METRICS | ({} if exact else _SKETCH_METRICS)


def to_long(
    wide: DataFrame,
    placed: dict[str, dict[str, str]],
    metric_types: dict[str, str],
    data_types: dict[str, str],
) -> DataFrame:
    """Unpivot the wide row of a group into one row per column."""
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(data_types.get(name)).cast("string").alias("data_type"),
                *[
                    (
                        F.col(quoted(where[m])).cast(t) if m in where else F.lit(None).cast(t)
                    ).alias(m)
                    for m, t in metric_types.items()
                ],
            )
            for name, where in placed.items()
        ]
    )
    return wide.select(*GROUP, F.explode(cells).alias("_cell")).select(*GROUP, "_cell.*")


def distinct_of_cells(cells: DataFrame, columns: list[str]) -> DataFrame:
    """``_gid, column_name, distinct_count`` of all groups."""
    blobs, buckets = packed(cells, columns, inner)
    return distinct_of_packed(bucket_sizes(blobs, buckets, packed_kinds(cells, columns, inner)), columns)


def selected_metrics(
    rows: DataFrame, cells: DataFrame, wide: DataFrame, columns: list[str], numbers: list[str]
) -> DataFrame:
    """Exact distinct counts and medians without value counts, from values that move once.

    ``wide`` is written and has a row for each group; ``cells`` are the same rows as ``rows``, not
    expanded.  Decimals are packed as texts, so their medians are selected.
    """
    groups = materialize(wide.select(group_id(GROUP).alias("_gid"), *GROUP), "groups")
    kinds = packed_kinds(cells, columns, inner)
    blobs, buckets = packed(cells, columns, inner)
    sizes = bucket_sizes(blobs, buckets, kinds)
    # Written, a row per group and column has a known size.
    found = materialize(distinct_of_packed(sizes, columns), "distinct")
    if numbers:
        whole = [c for c, k in zip(columns, kinds) if c in numbers and k != "text"]
        medians = medians_of_packed(blobs, buckets, sizes, kinds, columns, whole)
        if decimals := [c for c in numbers if c not in whole]:
            selected = order_statistics(rows, GROUP, decimals, source=inner)
            medians = medians.unionByName(selected.select(group_id(GROUP).alias("_gid"), "column_name", "median"))
        found = found.join(materialize(medians, "medians"), ["_gid", "column_name"], "left")
    else:
        found = found.withColumn("median", F.lit(None).cast("double"))
    return groups.join(found, "_gid").drop("_gid")


def moment_of(spec: MonitorSpec, as_of: dt.datetime | None) -> dt.datetime | None:
    """One moment for all jobs over a table without time: groups are told by it."""
    return as_of if as_of is not None or spec.timestamp_col is not None else dt.datetime.now(dt.timezone.utc)


def add_exact_metrics(long: DataFrame, exact: DataFrame) -> DataFrame:
    """Join exact distinct counts and medians to the long rows."""
    by = [*GROUP, "column_name"]
    long = join_null_safe(long, exact, by, "left")
    distinct = F.when(
        F.col("column_name") != TABLE, F.coalesce(F.col("distinct_count"), F.lit(0))
    )
    return long.withColumn("distinct_count", distinct)


def add_derived_metrics(long: DataFrame, spec: MonitorSpec) -> DataFrame:
    """Row-wise metrics: percent distinct and the user's derived expressions."""
    present = F.col("count") - F.col("num_nulls")
    long = long.withColumn(
        "percent_distinct", F.when(present > 0, F.col("distinct_count") / present)
    )
    for m in spec.metrics_of("derived"):
        value = F.expr(m.metric_definition).cast(m.output_type)
        long = long.withColumn(
            m.metric_name, F.when(F.col("column_name").isin(*m.input_columns), value)
        )
    return long


def profile(
    df: DataFrame,
    spec: MonitorSpec,
    log_type: str = INPUT,
    as_of: dt.datetime | None = None,
    counts: DataFrame | None = None,
    only_windows: DataFrame | None = None,
) -> DataFrame:
    """Analysis rows of ``df``: aggregate metrics, then derived ones."""
    rows = aggregate_metrics(df, spec, log_type, as_of, counts, only_windows)
    return add_derived_metrics(rows, spec)


def aggregate_metrics(
    df: DataFrame,
    spec: MonitorSpec,
    log_type: str = INPUT,
    as_of: dt.datetime | None = None,
    counts: DataFrame | None = None,
    only_windows: DataFrame | None = None,
) -> DataFrame:
    """Metrics that need the monitored rows.

    Exact distinct counts and medians come from value counts where these are at hand as a
    written table, else from bitmaps and by selection.
    """
    columns = analysed_columns(df, spec)
    as_of = moment_of(spec, as_of)
    data_types = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name in columns}
    selecting = spec.exact and counts is None
    numbers = [c for c in numeric_columns(df) if c in columns] if selecting else []
    at = _placed(df, spec, log_type, as_of, numbered=True)
    types = [at.rows.schema[inner(c)].dataType for c in columns]
    if by_cells(at, spec, types):
        wide, placed, metric_types = merged_aggregates(at, columns, types, only_windows, spec.exact)
    else:
        rows = group_rows(df, spec, log_type, as_of, only_windows)
        wide, placed, metric_types = wide_aggregates(rows, spec, columns)
    if selecting:
        wide = materialize(wide, "wide")
    long = to_long(wide, placed, metric_types, data_types)
    if selecting:
        cells = cell_rows(df, spec, log_type, as_of, only_windows)
        rows = group_rows(df, spec, log_type, as_of, only_windows)
        long = add_exact_metrics(long, selected_metrics(rows, cells, wide, columns, numbers))
    elif spec.exact:
        long = add_exact_metrics(long, distinct_and_median(counts, GROUP))
    return long.withColumn("log_type", F.lit(log_type))


def counted_columns(df: DataFrame, spec: MonitorSpec) -> list[str]:
    """Columns whose value counts are needed: numbers have sketches unless ``spec.exact``."""
    numbers = set(numeric_columns(df))
    return [c for c in analysed_columns(df, spec) if spec.exact or c not in numbers]


def group_value_counts(
    df: DataFrame,
    spec: MonitorSpec,
    log_type: str = INPUT,
    as_of: dt.datetime | None = None,
    only_windows: DataFrame | None = None,
) -> DataFrame:
    """Value counts of every counted column in every group of ``df``.

    Unless ``spec.exact``, counts of classes of values, whose number is bounded.
    """
    as_of = moment_of(spec, as_of)
    columns = counted_columns(df, spec)
    wanted = columns or analysed_columns(df, spec)
    if not spec.exact:
        placed = _placed(df, spec, log_type, as_of, numbered=True)
        counts = class_counts_of_cells(placed.rows, placed.once, placed.array(), GROUP, wanted, spec.category_classes, inner)
        if only_windows is not None:
            counts = join_null_safe(counts, only_windows, ["granularity", "window"], "left_semi")
        return counts if columns else counts.where(F.lit(False))
    counts = value_counts_of_cells(cell_rows(df, spec, log_type, as_of, only_windows), wanted, inner)
    counts = counts if columns else counts.where(F.lit(False))
    groups = group_list(df if columns else df.limit(0), spec, log_type, as_of, only_windows)
    return counts.join(groups, "_gid").select(*GROUP, *[c for c in counts.columns if c != "_gid"])
