"""Multi-step jobs: custom metrics, quality, stages, incremental refresh, lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import drift as D
from tidemark.operators import profile as P
from tidemark.operators import quality as Q
from tidemark.operators.distinct import distinct_counts, distinct_parts, merge_distinct_parts
from tidemark.operators.running import group_id
from tidemark.operators.setops import union_all
from tidemark.operators.windows import window_of
from tidemark.plans import monitors as M
from tidemark.plans import refresh as R
from tidemark.plans.files import differing, file_changes
from tidemark.queries.monitoring import (
    AS_OF,
    GENERIC,
    SKETCHED,
    YEARLY,
    EVERYTHING,
    _NUMBERS,
    _ORDER_LOG,
    _TEXTS,
    _YEAR_AVG,
    _YEAR_ROWS,
    _cat_sql,
    _ks_sql,
    R as rounded_sql,
    first_year,
    flat,
    lineitem,
    order_log,
    rounded,
    stamp,
)
from tidemark.queries.registry import query, table, tasks_of
from tidemark.session import materialize, scratch_name, scratch_path
from tidemark.sources.tables import SnapshotTable, save_table
from tidemark.spec import BASELINE, InferenceLog, Metric, MonitorSpec, TimeSeries

VARIATION = Metric("aggregate", "variation", ("o_totalprice",), "stddev(`{{column_name}}`) / avg(`{{column_name}}`)")
# Of the mean, as a share of it.
MEAN_ERROR = Metric("derived", "mean_error", ("o_totalprice",), "variation / sqrt(count)")
MEAN_ERROR_RATIO = Metric(
    "drift", "mean_error_ratio", ("o_totalprice",), "{{current_df}}.mean_error / {{base_df}}.mean_error"
)
ORDERS_BY_YEAR = MonitorSpec(
    TimeSeries("o_orderdate"),
    ("1 year",),
    columns=("o_totalprice",),
    custom_metrics=(VARIATION, MEAN_ERROR, MEAN_ERROR_RATIO),
)
_VARIATION = """m AS (SELECT strftime(date_trunc('year', o_orderdate), '%Y-%m-%d %H:%M:%S') AS window_start,
    stddev_samp(o_totalprice) / avg(o_totalprice) AS v, stddev_samp(o_totalprice) / avg(o_totalprice) / sqrt(count(*)) AS e
    FROM orders GROUP BY ALL)"""


def _custom(spark, sf) -> DataFrame:
    rows = P.profile(table(spark, sf, "orders"), ORDERS_BY_YEAR)
    return rows.where("column_name = 'o_totalprice'")


@query(
    "d18_custom_aggregate",
    f"WITH {_VARIATION} SELECT window_start, 'o_totalprice' AS column_name, {rounded_sql('v')} AS variation FROM m",
)
def custom_aggregate(spark, sf):
    return flat(_custom(spark, sf), "window", "column_name", "variation")


@query(
    "d19_custom_derived",
    f"WITH {_VARIATION} SELECT window_start, 'o_totalprice' AS column_name, {rounded_sql('e')} AS mean_error FROM m",
)
def custom_derived(spark, sf):
    return flat(_custom(spark, sf), "window", "column_name", "mean_error")


@query(
    "e9_custom_drift",
    f"""WITH {_VARIATION} SELECT * FROM (SELECT window_start, lag(window_start) OVER (ORDER BY window_start) AS window_cmp_start,
        'o_totalprice' AS column_name, {rounded_sql('e / lag(e) OVER (ORDER BY window_start)')} AS mean_error_ratio
        FROM m) WHERE window_cmp_start IS NOT NULL""",
)
def custom_drift(spark, sf):
    joined = D.pair_with_previous(_custom(spark, sf))
    rows = joined.select(
        "cur.window", "cur.window_cmp", "cur.column_name", *D.metric_deltas(joined, ORDERS_BY_YEAR)
    )
    return flat(rows, "window", "window_cmp", "column_name", "mean_error_ratio")


CLASSIFICATION_LOG = InferenceLog(
    "ts", "prediction", "source", "classification", label_col="quality", example_id_col="doc_id"
)


def document_log(spark, sf, labels: DataFrame | None = None) -> DataFrame:
    """Documents as a classification log: long texts are predicted to be good."""
    docs = table(spark, sf, "documents").select(
        "doc_id", "lang", "source", "n_chars",
        (F.col("n_chars") > 400).cast("int").alias("prediction"),
        F.timestamp_seconds(F.col("doc_id") * 3600 + 1704067200).alias("ts"),
    )
    labels = table(spark, sf, "labels").select("doc_id", "quality") if labels is None else labels
    return docs.join(labels, "doc_id", "left")


_DOCUMENT_LOG = """log_ AS (SELECT d.doc_id, lang, source, n_chars, (n_chars > 400)::INT AS prediction, quality
    FROM documents d LEFT JOIN labels USING (doc_id))"""


@query(
    "d20_classification_quality",
    f"""WITH {_DOCUMENT_LOG}, s AS (SELECT * FROM log_, LATERAL (VALUES (NULL, NULL), ('lang', lang)) AS s(slice_key, slice_value))
    SELECT slice_key, slice_value, source AS model_version, count(*) AS "count",
        {rounded_sql('avg((prediction = quality)::INT)')} AS accuracy_score FROM s GROUP BY ALL""",
)
def classification_quality(spark, sf):
    spec = MonitorSpec(CLASSIFICATION_LOG, ("100 years",), ("lang",), columns=("n_chars",), exact=False)
    rows = P.profile(document_log(spark, sf), spec).where("column_name = ':table'")
    return flat(rows, "slice_key", "slice_value", "model_version", "count", "accuracy_score")


@query(
    "d20_accuracy_of_doubles",
    f"""WITH {_DOCUMENT_LOG} SELECT source AS model_version, {rounded_sql('avg((prediction = quality)::INT)')} AS accuracy_score
    FROM log_ GROUP BY 1""",
)
def accuracy_of_doubles(spark, sf):
    """Predictions are doubles, labels are whole numbers."""
    spec = MonitorSpec(CLASSIFICATION_LOG, ("100 years",), columns=("n_chars",))
    log = document_log(spark, sf).withColumn("prediction", F.col("prediction").cast("double"))
    rows = P.profile(log, spec).where("column_name = ':table'")
    return flat(rows, "model_version", "accuracy_score")


@query(
    "d20_confusion_matrix",
    f"WITH {_DOCUMENT_LOG} SELECT lang, quality, prediction, count(*) AS n FROM log_ WHERE quality IS NOT NULL GROUP BY ALL",
)
def confusion_matrix(spark, sf):
    return Q.confusion_counts(document_log(spark, sf), "quality", "prediction", ["lang"])


@query(
    "d20_precision_recall_f1",
    f"""WITH {_DOCUMENT_LOG}, c AS (SELECT lang, count(*) FILTER (quality = 1 AND prediction = 1) AS tp,
        count(*) FILTER (quality = 0 AND prediction = 1) AS fp, count(*) FILTER (quality = 1 AND prediction = 0) AS fn
        FROM log_ WHERE quality IS NOT NULL GROUP BY lang)
    SELECT lang, {rounded_sql('coalesce(tp / nullif(tp + fp, 0), 0)')} AS "precision",
        {rounded_sql('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall,
        {rounded_sql('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1 FROM c""",
)
def precision_recall_f1(spark, sf):
    log = document_log(spark, sf).select(
        "lang", (F.col("quality") == 1).alias("y"), (F.col("prediction") == 1).alias("p")
    )
    return flat(Q.precision_recall_f1(log, "y", "p", ["lang"]), "lang", "precision", "recall", "f1")


@query(
    "d21_regression_quality",
    f"""WITH {_ORDER_LOG}
    SELECT window_start, model_version, o_orderpriority AS slice_value,
        {rounded_sql('avg((prediction - o_totalprice) ** 2)', 0)} AS mean_squared_error,
        {rounded_sql('sqrt(avg((prediction - o_totalprice) ** 2))', 3)} AS root_mean_squared_error,
        {rounded_sql('avg(abs(prediction - o_totalprice))', 3)} AS mean_absolute_error
    FROM log_ GROUP BY ALL""",
)
def regression_quality(spark, sf):
    log = InferenceLog("o_orderdate", "prediction", "model_version", "regression", "o_totalprice", "o_orderkey")
    spec = MonitorSpec(log, ("1 year",), ("o_orderpriority",), columns=("o_totalprice",), exact=False)
    rows = P.profile(order_log(spark, sf), spec).where("column_name = ':table' AND slice_key IS NOT NULL")
    return rows.select(
        stamp(F.col("window.start")).alias("window_start"), "model_version", "slice_value",
        rounded(F.col("mean_squared_error"), 0).alias("mean_squared_error"),
        rounded(F.col("root_mean_squared_error"), 3).alias("root_mean_squared_error"),
        rounded(F.col("mean_absolute_error"), 3).alias("mean_absolute_error"),
    )


@query(
    "e11_roc_auc",
    f"""WITH {_DOCUMENT_LOG}, s AS (SELECT source, n_chars, count(*) FILTER (quality = 1) AS p,
        count(*) FILTER (quality = 0) AS n FROM log_ WHERE quality IS NOT NULL GROUP BY ALL),
    r AS (SELECT source, n, p, sum(p) OVER w AS tp, sum(p) OVER (PARTITION BY source) AS tot_p, sum(n) OVER (PARTITION BY source) AS tot_n
        FROM s WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC))
    SELECT source, {rounded_sql('sum(n * (tp - p / 2)) / nullif(max(tot_p) * max(tot_n), 0)')} AS auc FROM r GROUP BY source""",
)
def roc_auc(spark, sf):
    log = document_log(spark, sf).withColumn("y", F.col("quality") == 1)
    return flat(Q.roc_auc(log, "n_chars", "y", ["source"]), "source", "auc")


@query(
    "e11_roc_curve",
    f"""WITH {_DOCUMENT_LOG}, s AS (SELECT n_chars, count(*) FILTER (quality = 1) AS p,
        count(*) FILTER (quality = 0) AS n FROM log_ WHERE quality IS NOT NULL GROUP BY ALL)
    SELECT n_chars::DOUBLE AS threshold, {rounded_sql('sum(n) OVER w / sum(n) OVER ()')} AS fpr,
        {rounded_sql('sum(p) OVER w / sum(p) OVER ()')} AS tpr FROM s WINDOW w AS (ORDER BY n_chars DESC)""",
)
def roc_curve(spark, sf):
    log = document_log(spark, sf).withColumn("y", F.col("quality") == 1)
    return flat(Q.roc_curve(log, "n_chars", "y"), "threshold", "fpr", "tpr")


@query(
    "e11_roc_auc_null_keys",
    f"""WITH {_DOCUMENT_LOG}, s AS (SELECT CASE WHEN doc_id % 2 = 0 THEN lang END AS a, CASE WHEN doc_id % 2 = 1 THEN lang END AS b,
        n_chars, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n FROM log_ WHERE quality IS NOT NULL GROUP BY ALL),
    r AS (SELECT a, b, n, p, sum(p) OVER w AS tp, sum(p) OVER (PARTITION BY a, b) AS tot_p, sum(n) OVER (PARTITION BY a, b) AS tot_n
        FROM s WINDOW w AS (PARTITION BY a, b ORDER BY n_chars DESC))
    SELECT a, b, {rounded_sql('sum(n * (tp - p / 2)) / nullif(max(tot_p) * max(tot_n), 0)')} AS auc FROM r GROUP BY a, b""",
)
def roc_auc_null_keys(spark, sf):
    """Groups whose keys hold the same value in another column, NULL in the rest."""
    even = F.col("doc_id") % 2 == 0
    log = document_log(spark, sf).select(
        "n_chars", (F.col("quality") == 1).alias("y"), F.when(even, F.col("lang")).alias("a"), F.when(~even, F.col("lang")).alias("b")
    )
    return flat(Q.roc_auc(log, "n_chars", "y", ["a", "b"]), "a", "b", "auc")


# stages and refresh --------------------------------------------------------------

_ALL_DRIFT = f"""SELECT * FROM (
    SELECT drift_type, window_start, window_cmp_start, slice_key, slice_value, column_name,
        ks_statistic, ks_pvalue, NULL::DOUBLE AS chi_squared_statistic, NULL::BIGINT AS chi_squared_dof,
        NULL::DOUBLE AS tv_distance FROM ({_ks_sql('BASELINE')} UNION ALL {_ks_sql('CONSECUTIVE')})
    UNION ALL
    SELECT drift_type, window_start, window_cmp_start, slice_key, slice_value, column_name,
        NULL, NULL, chi_squared_statistic, chi_squared_dof, tv_distance
    FROM ({_cat_sql('BASELINE')} UNION ALL {_cat_sql('CONSECUTIVE')}))"""
_DRIFT_OUT = [
    "drift_type", "window", "window_cmp", "slice_key", "slice_value", "column_name",
    "ks_statistic", "ks_pvalue", "chi_squared_statistic", "chi_squared_dof", "tv_distance",
]


def _stages(spark, sf, spec):
    scored = R.run_stages(lineitem(spark, sf), spec)
    base = R.run_stages(first_year(spark, sf), spec, BASELINE)
    return scored, base


@query("e10_drift_table", _ALL_DRIFT)
def drift_table(spark, sf):
    """Both drift types with every distance: the whole drift table of a monitor."""
    scored, base = _stages(spark, sf, YEARLY)
    rows = R.drift_stage(scored, YEARLY, base).where("column_name != ':table'")
    return flat(rows, *_DRIFT_OUT)


_QUANTITY_ONLY = YEARLY.with_params(columns=("l_discount", "l_returnflag"))


@query(
    "d15_three_stages",
    f"""WITH {_YEAR_AVG}
    SELECT window_start, slice_key, slice_value, 'l_discount' AS column_name, n AS "count", {rounded_sql('dist')} AS percent_distinct,
        {rounded_sql('mean - lag(mean) OVER s')} AS avg_delta,
        {rounded_sql('zeros - lag(zeros) OVER s')} AS percent_zeros_delta
    FROM m WINDOW s AS (PARTITION BY slice_key, slice_value ORDER BY window_start)""",
)
def three_stages(spark, sf):
    """Aggregate, derive, compare; the comparison joined back to the metric rows."""
    spec = _QUANTITY_ONLY
    stage = R.derived_stage(R.aggregate_stage(lineitem(spark, sf), spec), spec)
    moved = R.drift_stage(stage, spec).select(*P.GROUP, "column_name", "avg_delta", "percent_zeros_delta")
    rows = D.join_null_safe(stage.metrics, moved, [*P.GROUP, "column_name"], "left")
    return flat(
        rows.where("column_name = 'l_discount'"), "window", "slice_key", "slice_value", "column_name",
        "count", "percent_distinct", "avg_delta", "percent_zeros_delta",
    )


@query(
    "d25_category_counts_of_metrics",
    f"SELECT drift_type, count(*) AS n FROM ({_ALL_DRIFT}) GROUP BY drift_type",
)
def counts_of_drift_types(spark, sf):
    scored, base = _stages(spark, sf, YEARLY)
    rows = R.drift_stage(scored, YEARLY, base).where("column_name != ':table'")
    return rows.groupBy("drift_type").agg(F.count("*").alias("n"))


def _before_late(df: DataFrame) -> DataFrame:
    late = "year(l_shipdate) IN (1997, 1999) AND l_orderkey % 5 = 0"
    return df.where(f"NOT ({late})")


def _old_lineitem(spark, sf) -> DataFrame:
    """The table before a late batch: some rows of 1997 and 1999 were missing."""
    return _before_late(lineitem(spark, sf))


def _kept_lineitem(spark, sf, *columns: str) -> DataFrame:
    """The rows dealt out once and written, for queries that read them several times."""
    return materialize(lineitem(spark, sf).select(*columns or ["*"]), "lineitem")


@query(
    "a9_changed_rows",
    """SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS changed
    FROM lineitem WHERE year(l_shipdate) IN (1997, 1999) AND l_orderkey % 5 = 0 GROUP BY ALL""",
)
def changed_rows(spark, sf):
    changed = R.changed_rows(_old_lineitem(spark, sf), lineitem(spark, sf))
    month = F.date_trunc("month", "l_shipdate")
    return changed.groupBy(stamp(month).alias("window_start")).agg(F.sum("_change").alias("changed"))


def _stored(df: DataFrame, sf: str, folder: str | None = None, partition_by: tuple[str, ...] = ()) -> str:
    """The rows as a table of the catalog, in files by shipping date."""
    folder = folder or scratch_path(df.sparkSession, "lineitem")
    files = tasks_of(table(df.sparkSession, sf, "lineitem"), 8)
    return save_table(df.repartitionByRange(files, "l_shipdate"), scratch_name("lineitem"), path=folder, partition_by=partition_by)


def _late_lineitem(spark, sf) -> DataFrame:
    return lineitem(spark, sf).where("year(l_shipdate) IN (1997, 1999) AND l_orderkey % 5 = 0")


_MEDIAN = "quantile_disc({c}, 0.5)::DOUBLE"


@query(
    "d16_incremental_refresh",
    f"WITH {_YEAR_ROWS} "
    + " UNION ALL ".join(
        f"""SELECT window_start, slice_key, slice_value, '{c}' AS column_name, count(*) AS "count",
        count(DISTINCT {c}) AS distinct_count, {_MEDIAN.format(c=c) if c in _NUMBERS else 'NULL::DOUBLE'} AS median,
        {rounded_sql(f'avg({c})', 4) if c in _NUMBERS else 'NULL::DOUBLE'} AS "avg" FROM rows_ GROUP BY ALL"""
        for c in (*_NUMBERS, *_TEXTS)
    ),
)
def incremental_refresh(spark, sf):
    """Exact metrics of all columns before a late batch, brought up to date by its files."""
    spec = EVERYTHING.with_params(granularities=("1 year",))
    name = _stored(_old_lineitem(spark, sf), sf)
    before = R.run_stages(spark.table(name), spec, counted=False).metrics
    seen = file_changes(spark.table(name), spec, None)
    save_table(_late_lineitem(spark, sf), name, mode="append")
    new = spark.table(name)
    files, touched = file_changes(new, spec, seen.files)
    rows = R.refresh_analysis(new, spec, before, touched, files).where("column_name != ':table'")
    return flat(
        rows, "window", "slice_key", "slice_value", "column_name", "count", "distinct_count", "median", "avg", digits=4
    )


@query(
    "a9_changed_rows_by_files",
    """SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS changed
    FROM lineitem WHERE year(l_shipdate) IN (1997, 1999) AND l_orderkey % 5 = 0 GROUP BY ALL""",
)
def changed_rows_by_files(spark, sf):
    """Two states of a table that share most files: only the others are compared."""
    name = _stored(_old_lineitem(spark, sf), sf)
    old = spark.read.parquet(*spark.table(name).inputFiles())
    save_table(_late_lineitem(spark, sf), name, mode="append")
    changed = R.changed_rows(*differing(old, spark.table(name)))
    month = F.date_trunc("month", "l_shipdate")
    return changed.groupBy(stamp(month).alias("window_start")).agg(F.sum("_change").alias("changed"))


@query(
    "d16_sketched_refresh",
    f"WITH {_YEAR_ROWS} "
    + " UNION ALL ".join(
        f"""SELECT window_start, slice_key, slice_value, '{c}' AS column_name, count(*) AS "count",
        {rounded_sql(f'avg({c})', 4)} AS "avg", {rounded_sql(f'stddev_samp({c})', 4)} AS stddev FROM rows_ GROUP BY ALL"""
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
)
def sketched_refresh(spark, sf):
    """The same over all columns, with sketches instead of value counts."""
    spec = SKETCHED.with_params(granularities=("1 year",))
    new = _kept_lineitem(spark, sf)
    old = _before_late(new)
    before = R.run_stages(old, spec, counted=False).metrics
    touched = R.moved_windows(R.window_marks(old, spec), R.window_marks(new, spec))
    rows = R.refresh_analysis(new, spec, before, touched).where("avg IS NOT NULL")
    return flat(rows, "window", "slice_key", "slice_value", "column_name", "count", "avg", "stddev", digits=4)


@query(
    "d16_incremental_drift",
    f"SELECT * EXCLUDE (ks_pvalue) FROM ({_ks_sql('CONSECUTIVE')}) WHERE column_name <> 'l_quantity'",
)
def incremental_drift(spark, sf):
    spec = YEARLY.with_params(columns=("l_discount", "l_extendedprice"))
    new = _kept_lineitem(spark, sf)
    old = _before_late(new)
    before = R.monitor(old, spec)
    touched = R.touched_windows(R.changed_rows(old, new), spec)
    analysis = R.refresh_analysis(new, spec, before.analysis, touched)
    rows = R.refresh_drift(new, spec, before.drift, analysis, touched)
    return flat(
        rows.where("column_name != ':table'"), "drift_type", "window", "window_cmp", "slice_key",
        "slice_value", "column_name", "ks_statistic",
    )


@query(
    "a9_changed_rows_with_new_column",
    """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS changed
    FROM orders WHERE o_orderkey % 7 = 0 GROUP BY ALL""",
)
def changed_rows_with_new_column(spark, sf):
    """A column was added, and is filled in for some rows only."""
    old = table(spark, sf, "orders")
    new = old.withColumn("note", F.when(F.col("o_orderkey") % 7 == 0, F.lit("checked")))
    changed = R.changed_rows(old, new).where("_change > 0")
    month = F.date_trunc("month", "o_orderdate")
    return changed.groupBy(stamp(month).alias("window_start")).agg(F.sum("_change").alias("changed"))


@query(
    "d17_moments_of_large_values",
    f"""SELECT strftime(date_trunc('year', o_orderdate), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS "count",
        {rounded_sql('stddev_samp((epoch_ms(o_orderdate) - 700000000000) / 1e6)', 3)} AS stddev FROM orders GROUP BY 1""",
)
def moments_of_large_values(spark, sf):
    """Five batches of moments in milliseconds, far from zero, merged."""
    df = table(spark, sf, "orders").select(
        "o_orderdate", "o_orderkey", (F.unix_millis(F.col("o_orderdate").cast("timestamp")) + 10**12).alias("x")
    )
    spec = MonitorSpec(TimeSeries("o_orderdate"), ("1 year",), columns=("x",))
    parts = [R.aggregate_base(df.where(f"o_orderkey % 5 = {i}"), spec) for i in range(5)]
    rows = R.finish_aggregate_base(R.merge_aggregate_base(union_all(parts))).where("column_name = 'x'")
    rows = rows.withColumn("stddev", F.col("stddev") / 1e6)
    return flat(rows, "window", "count", "stddev", digits=3)


@query(
    "d17_merged_exact_distinct",
    f"WITH {_YEAR_ROWS} "
    + " UNION ALL ".join(
        f"SELECT window_start, slice_key, slice_value, '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count FROM rows_ GROUP BY ALL"
        for c in (*_NUMBERS, *_TEXTS)
    ),
)
def merged_exact_distinct(spark, sf):
    """Bitmaps of five batches of all columns, kept apart, then merged over batches, months into years and cells into slices."""
    columns, months = [*_NUMBERS, *_TEXTS], EVERYTHING
    by = ["window", "slice_key", "slice_value"]
    df = lineitem(spark, sf)
    parts = [
        distinct_parts(P.cell_rows(df.where(f"l_linenumber * 7 % 5 = {i}"), months), ["_gids"], columns, P.inner)
        for i in range(5)
    ]
    kept = materialize(union_all(parts), "parts")
    # A row per month and slice.
    groups = P.group_list(df, months).withColumn("window", window_of(F.col("window.start"), "1 year"))
    years = materialize(groups.select("_gid", group_id(by).alias("_year"), *by), "years")
    spread = kept.withColumn("_gid", F.explode("_gids")).drop("_gids").join(years.select("_gid", "_year"), "_gid").drop("_gid")
    counts = materialize(distinct_counts(merge_distinct_parts(spread, ["_year"]), ["_year"]), "distinct")
    named = years.drop("_gid").distinct().join(counts, "_year")
    return flat(named, *by, "column_name", "distinct_count")


@query(
    "d17_mergeable_base",
    f"""WITH {_YEAR_ROWS}
    SELECT window_start, slice_key, slice_value, 'l_quantity' AS column_name, count(*) AS "count",
        min(l_quantity) AS "min", max(l_quantity) AS "max", {rounded_sql('avg(l_quantity)')} AS "avg",
        {rounded_sql('stddev_samp(l_quantity)')} AS stddev, count(DISTINCT l_quantity) AS distinct_count,
        NULL::DOUBLE AS avg_length, NULL::BIGINT AS non_null_columns
    FROM rows_ GROUP BY ALL
    UNION ALL SELECT window_start, slice_key, slice_value, 'l_returnflag', count(*), NULL, NULL, NULL, NULL,
        count(DISTINCT l_returnflag), {rounded_sql('avg(length(l_returnflag))')}, NULL FROM rows_ GROUP BY ALL
    UNION ALL SELECT window_start, slice_key, slice_value, ':table', count(*), NULL, NULL, NULL, NULL, NULL, NULL, 2
    FROM rows_ GROUP BY ALL""",
)
def mergeable_base(spark, sf):
    """Two batches aggregated apart and merged."""
    spec = YEARLY.with_params(columns=("l_quantity", "l_returnflag"))
    df = lineitem(spark, sf)
    parts = [R.aggregate_base(df.where(f"l_orderkey % 2 = {i}"), spec) for i in (0, 1)]
    rows = R.finish_aggregate_base(R.merge_aggregate_base(parts[0].unionByName(parts[1])))
    return flat(
        rows, "window", "slice_key", "slice_value", "column_name", "count", "min", "max", "avg",
        "stddev", "distinct_count", "avg_length", "non_null_columns",
    )


# lifecycle -----------------------------------------------------------------------


def _monitors(spark, sf) -> M.Monitors:
    """Monitors over temporary views of the given tables, in a fresh folder."""
    for name in ("lineitem", "orders", "customer"):
        table(spark, sf, name).createOrReplaceTempView(f"watched_{name}")
    return M.Monitors(spark, scratch_path(spark, "monitors"))


_LIFECYCLE = SKETCHED.with_params(
    granularities=("1 year",), slicing_exprs=("l_returnflag",), columns=("l_discount", "l_extendedprice", "l_partkey")
)
_LIFECYCLE_SQL = f"WITH {_YEAR_ROWS} SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT window_start, slice_key, slice_value, '{c}' AS column_name, count(*) AS "count",
        {rounded_sql(f'avg({c})', 4)} AS "avg" FROM rows_ GROUP BY ALL"""
    for c in _LIFECYCLE.columns
) + ") WHERE slice_key IS DISTINCT FROM 'l_quantity > 25'"


def _metric_rows(monitors: M.Monitors, name: str, *more: str) -> DataFrame:
    rows = monitors.analysis(name).where("column_name != ':table'")
    return flat(rows, "window", "slice_key", "slice_value", "column_name", "count", "avg", *more, digits=4)


@query("p1_create_monitor", _LIFECYCLE_SQL)
def create_monitor(spark, sf):
    monitors = _monitors(spark, sf)
    monitors.create_or_update("watched_lineitem", _LIFECYCLE)
    return _metric_rows(monitors, "watched_lineitem")


@query("p2_update_monitor", f"SELECT * FROM ({_LIFECYCLE_SQL}) WHERE slice_key IS NULL")
def update_monitor(spark, sf):
    """Slices are dropped by an update; the next refresh follows the new parameters."""
    monitors = _monitors(spark, sf)
    monitors.create_or_update("watched_lineitem", _LIFECYCLE, skip_analysis=True)
    monitors.update("watched_lineitem", slicing_exprs=())
    monitors.refresh("watched_lineitem", backfill=True)
    return _metric_rows(monitors, "watched_lineitem")


_WIDTH = Metric("aggregate", "width", ("l_extendedprice",), "max(`{{column_name}}`) - min(`{{column_name}}`)")


@query(
    "p2_new_metric_without_backfill",
    f"""WITH {_YEAR_ROWS}, m AS (SELECT window_start, slice_key, slice_value, count(*) AS n, avg(l_extendedprice) AS mean,
        max(l_extendedprice) - min(l_extendedprice) AS width FROM rows_ GROUP BY ALL)
    SELECT window_start, slice_key, slice_value, 'l_extendedprice' AS column_name, n AS "count", {rounded_sql('mean', 4)} AS "avg",
        CASE WHEN window_start[:4] IN ('1997', '1999') THEN {rounded_sql('width', 4)} END AS width
    FROM m WHERE slice_key IS DISTINCT FROM 'l_quantity > 25'""",
)
def new_metric_without_backfill(spark, sf):
    """A metric is added; it appears in the windows that the next refresh recomputes."""
    monitors, new = _monitors(spark, sf), _kept_lineitem(spark, sf)
    _before_late(new).createOrReplaceTempView("watched_lineitem")
    monitors.create_or_update("watched_lineitem", _LIFECYCLE)
    monitors.update("watched_lineitem", custom_metrics=(_WIDTH,))
    new.createOrReplaceTempView("watched_lineitem")
    monitors.refresh("watched_lineitem")
    return _metric_rows(monitors, "watched_lineitem", "width").where("column_name = 'l_extendedprice'")


@query("p3_refresh_monitor", _LIFECYCLE_SQL)
def refresh_monitor(spark, sf):
    """First analysis on the old rows, then a refresh that finds what has changed."""
    monitors, new = _monitors(spark, sf), _kept_lineitem(spark, sf)
    _before_late(new).createOrReplaceTempView("watched_lineitem")
    monitors.create_or_update("watched_lineitem", _LIFECYCLE)
    new.createOrReplaceTempView("watched_lineitem")
    monitors.refresh("watched_lineitem")
    return _metric_rows(monitors, "watched_lineitem")


@query("p3_refresh_by_files", _LIFECYCLE_SQL)
def refresh_by_files(spark, sf):
    """A table on files is analysed; a late batch adds files; a refresh reads what they touch."""
    monitors, name = _monitors(spark, sf), _stored(_old_lineitem(spark, sf), sf)
    monitors.create_or_update(name, _LIFECYCLE)
    save_table(_late_lineitem(spark, sf), name, mode="append")
    monitors.refresh(name)
    return _metric_rows(monitors, name)


@query(
    "p3_refresh_after_removal",
    f"""SELECT * FROM ({_LIFECYCLE_SQL.replace('FROM rows_', "FROM rows_ WHERE year(l_shipdate) NOT IN (1995, 1996) OR l_orderkey % 2 = 0")})""",
)
def refresh_after_removal(spark, sf):
    """The files of two partitions are replaced by others with fewer rows."""
    monitors, year, folder = _monitors(spark, sf), F.year("l_shipdate"), scratch_path(spark, "lineitem")
    name = _stored(lineitem(spark, sf).withColumn("year", year), sf, folder, ("year",))
    monitors.create_or_update(name, _LIFECYCLE)
    fewer = lineitem(spark, sf).where(year.isin(1995, 1996) & (F.col("l_orderkey") % 2 == 0))
    write = fewer.withColumn("year", year).write.mode("overwrite").partitionBy("year")
    write.option("partitionOverwriteMode", "dynamic").parquet(folder)
    monitors.refresh(name)
    return _metric_rows(monitors, name)


@query(
    "p3_refresh_after_a_move",
    f"""SELECT strftime(date_trunc('year', l_shipdate), '%Y-%m-%d %H:%M:%S') AS window_start, c AS column_name, count(*) AS "count",
        count(*) - count(v) AS num_nulls, {rounded_sql('avg(v)', 4)} AS "avg"
    FROM lineitem, LATERAL (VALUES ('a', CASE WHEN l_linenumber % 2 = (year(l_shipdate) = 1995)::INT THEN l_quantity END),
        ('b', CASE WHEN l_linenumber % 2 <> (year(l_shipdate) = 1995)::INT THEN l_quantity END)) AS s(c, v) GROUP BY ALL""",
)
def refresh_after_a_move(spark, sf):
    """In one year all values move to the other column; no row is added or removed."""
    monitors = _monitors(spark, sf)
    rows = _kept_lineitem(spark, sf, "l_shipdate", "l_linenumber", "l_quantity")
    odd = F.col("l_linenumber") % 2 == 1

    def show(first: Column) -> None:
        a, b = F.when(first, F.col("l_quantity")), F.when(~first, F.col("l_quantity"))
        rows.select("l_shipdate", a.alias("a"), b.alias("b")).createOrReplaceTempView("watched_lineitem")

    show(~odd)
    monitors.create_or_update("watched_lineitem", YEARLY.with_params(columns=("a", "b"), slicing_exprs=(), exact=False))
    show(odd == (F.year("l_shipdate") == 1995))
    monitors.refresh("watched_lineitem")
    found = monitors.analysis("watched_lineitem").where("column_name != ':table'")
    return flat(found, "window", "column_name", "count", "num_nulls", "avg", digits=4)


@query(
    "p3_refresh_with_new_column",
    f"""WITH {_YEAR_ROWS}, late AS (SELECT * FROM rows_ WHERE window_start[:4] IN ('1997', '1999'))
    SELECT * FROM ({_LIFECYCLE_SQL.split(' ', 1)[1].split(' SELECT * FROM (', 1)[1].rsplit(') WHERE', 1)[0]})
        WHERE slice_key IS DISTINCT FROM 'l_quantity > 25'
    UNION ALL SELECT window_start, slice_key, slice_value, 'half', count(*), {rounded_sql('avg(l_quantity / 2)', 4)} FROM late
        WHERE slice_key IS DISTINCT FROM 'l_quantity > 25' GROUP BY ALL""",
)
def refresh_with_new_column(spark, sf):
    """The table has gained a column, filled in for two years, when it is refreshed."""
    monitors = _monitors(spark, sf)
    spec = _LIFECYCLE.with_params(columns=None)
    columns = ["l_shipdate", "l_returnflag", *_LIFECYCLE.columns]
    new = _kept_lineitem(spark, sf, *columns, "l_quantity", "l_orderkey")
    old = _before_late(new)
    old.select(*columns).createOrReplaceTempView("watched_lineitem")
    monitors.create_or_update("watched_lineitem", spec)
    half = F.when(F.year("l_shipdate").isin(1997, 1999), F.col("l_quantity") / 2)
    new.select(*columns, half.alias("half")).createOrReplaceTempView("watched_lineitem")
    monitors.refresh("watched_lineitem", changed=R.changed_rows(old.select(*columns), new.select(*columns)))
    rows = monitors.analysis("watched_lineitem").where("column_name NOT IN (':table', 'l_returnflag')")
    return flat(rows, "window", "slice_key", "slice_value", "column_name", "count", "avg", digits=4)


@query(
    "p3_refresh_without_time",
    f"""WITH s AS (SELECT '2024-02-01 00:00:00' AS w, c_acctbal FROM customer WHERE c_custkey % 3 <> 0
        UNION ALL SELECT '2024-02-02 00:00:00', c_acctbal FROM customer),
    m AS (SELECT w, count(*) AS n, avg(c_acctbal) AS mean FROM s GROUP BY w)
    SELECT 'CONSECUTIVE' AS drift_type, b.w AS window_start, a.w AS window_cmp_start, 'c_acctbal' AS column_name,
        b.n - a.n AS count_delta, {rounded_sql('b.mean - a.mean')} AS avg_delta FROM m a JOIN m b ON a.w < b.w""",
)
def refresh_without_time(spark, sf):
    """Each refresh of a table without time is a window; the second is compared to the first."""
    import datetime as dt

    monitors = _monitors(spark, sf)
    customer = table(spark, sf, "customer")
    customer.where("c_custkey % 3 != 0").createOrReplaceTempView("watched_customer")
    monitors.create_or_update("watched_customer", GENERIC.with_params(columns=("c_acctbal",)), as_of=AS_OF)
    customer.createOrReplaceTempView("watched_customer")
    monitors.refresh("watched_customer", as_of=AS_OF + dt.timedelta(days=1))
    rows = monitors.drift("watched_customer").where("column_name = 'c_acctbal'")
    return flat(rows, "drift_type", "window", "window_cmp", "column_name", "count_delta", "avg_delta")


_YEARS = "(SELECT count(DISTINCT year(o_orderdate)) * 2 FROM orders)"


@query(
    "p4_delete_monitor",
    f"""SELECT unnest(['watched_orders', 'kept_orders']) AS table_name, unnest([0, {_YEARS}]) AS n_metric_rows,
        'MONITOR_NOT_FOUND' AS code""",
)
def delete_monitor(spark, sf):
    """Two monitors are deleted, one with its metric tables; neither is found afterwards."""
    monitors = _monitors(spark, sf)
    table(spark, sf, "orders").createOrReplaceTempView("kept_orders")
    out = []
    for name, purge in (("watched_orders", True), ("kept_orders", False)):
        path = monitors.create_or_update(name, ORDERS_BY_YEAR).analysis_metrics_path
        monitors.delete(name, purge_artifacts=purge)
        try:
            monitors.info(name)
            code = "FOUND"
        except M.MonitorError as error:
            code = error.code
        metrics = SnapshotTable(spark, path)
        rows = metrics.read() if metrics.exists() else spark.range(0)
        out.append(rows.agg(F.count("*").alias("n_metric_rows")).select(F.lit(name).alias("table_name"), "n_metric_rows", F.lit(code).alias("code")))
    return out[0].union(out[1])


@query(
    "p5_monitors_by_entity",
    f"""SELECT 'watched_orders' AS table_name, {_YEARS} AS n_metric_rows
    UNION ALL SELECT 'watched_customer', (SELECT count(DISTINCT c_mktsegment) + 1 FROM customer) * 2""",
)
def monitors_by_entity(spark, sf):
    """The monitors of an entity, with the size of their metric tables."""
    monitors = _monitors(spark, sf)
    by_segment = GENERIC.with_params(slicing_exprs=("c_mktsegment",), columns=("c_acctbal",))
    monitors.create_or_update("watched_lineitem", _LIFECYCLE, linked_entities=["a"], skip_analysis=True)
    monitors.create_or_update("watched_orders", ORDERS_BY_YEAR, linked_entities=["a", "b"])
    monitors.create_or_update("watched_customer", by_segment, linked_entities=["b"], as_of=AS_OF)
    names = [r["table_name"] for r in monitors.by_entity("b").collect()]
    return union_all(
        [
            monitors.analysis(n).agg(F.count("*").alias("n_metric_rows")).select(F.lit(n).alias("table_name"), "n_metric_rows")
            for n in names
        ]
    )


@query(
    "p6_logging_table",
    f"""WITH {_DOCUMENT_LOG}
    SELECT 'BASELINE' AS log_type, lang, count(*) AS n, 0 AS labelled FROM log_ WHERE doc_id % 4 = 0 GROUP BY lang
    UNION ALL SELECT 'INPUT', lang, count(*), count(quality) FROM log_ WHERE doc_id % 4 <> 0 GROUP BY lang""",
)
def logging_table(spark, sf):
    """Baseline logged twice, scored rows in two batches, one batch taken back, then
    logged again, and all labels filled in.  The version has signs that paths escape."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType(), False),
            T.StructField("lang", T.StringType()),
            T.StructField("n_chars", T.LongType()),
            T.StructField("quality", T.IntegerType()),
        ]
    )
    log, version = M.LoggingTable(spark, scratch_path(spark, "logging"), schema, ["doc_id"]), "v:1/a=b#c"
    log.log_baseline(docs.where("doc_id % 8 = 0"), version, "first")
    log.log_baseline(docs.where("doc_id % 4 = 0"), version, "second")
    log.log_scored(docs.where("doc_id % 4 = 1"), version, "a")
    log.log_scored(docs.where("doc_id % 4 > 1"), version, "b")
    log.remove_batch("INPUT", version, "b")
    log.log_scored(docs.where("doc_id % 4 > 1"), version, "c")
    log.log_labels(table(spark, sf, "labels"), "quality")
    return log.read().groupBy("log_type", "lang").agg(
        F.count("*").alias("n"), F.count("quality").alias("labelled")
    )
