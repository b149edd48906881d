"""Alert thresholds for metrics and drift metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col, join_null_safe
from tidemark.functions.draws import uniforms
from tidemark.functions.stats import t_quantile
from tidemark.operators import bootstrap as B
from tidemark.operators.counts import value_counts
from tidemark.operators.drift import category_tests, ks_statistics
from tidemark.operators.selection import order_statistics
from tidemark.operators.setops import union_all
from tidemark.session import materialize

COLUMNS = ["metric", "interval_width", "column_name", "low", "high"]

# Fixed names: drift metrics and what is measured between a replicate and the baseline.
DISTANCES = {
    "chi_squared_test": "chi_squared_statistic",
    "tv_distance": "tv_distance",
    "ks_test": "ks_statistic",
}
DELTA_OF = {
    "avg_delta": "avg",
    "stddev_delta": "stddev",
    "percent_zeros_delta": "percent_zeros",
    "percent_null_delta": "percent_null",
}


def mean_interval(
    df: DataFrame,
    columns: Sequence[str],
    confidence: float,
    expected_n: int | None = None,
    at_most: bool = False,
) -> DataFrame:
    """t interval of the mean, all columns in one aggregate.

    ``expected_n`` is the size of the data to be scored; with ``at_most`` the smaller of
    both sizes is used.
    """
    wide = df.agg(
        *[
            F.struct(
                F.avg(col(c)).cast("double").alias("mean"),
                F.stddev_samp(col(c)).alias("sd"),
                F.count(col(c)).alias("n"),
            ).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    )
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("s"))
            for i, c in enumerate(columns)
        ]
    )
    rows = wide.select(F.explode(cells).alias("_c")).select("_c.column_name", "_c.s.*")
    size = F.col("n")
    if expected_n is not None:
        size = F.least(size, F.lit(expected_n)) if at_most else F.lit(expected_n)
    breadth = t_quantile(size - 1, confidence) * F.col("sd") / F.sqrt(F.nullif(size, F.lit(0)))
    return rows.select(
        F.lit("avg").alias("metric"),
        F.lit(confidence).alias("interval_width"),
        "column_name",
        (F.col("mean") - breadth).alias("low"),
        (F.col("mean") + breadth).alias("high"),
    )


def median_interval(df: DataFrame, columns: Sequence[str], confidence: float) -> DataFrame:
    """Order-statistic interval of the median.

    Ranks count the non-NULL values of each column and stay within 1..n.
    """

    def breadth(n: Column) -> Column:
        return t_quantile(n - 1, confidence) * F.sqrt(n / 4)

    ranks = {
        "low": lambda n: F.greatest(F.lit(1), F.ceil(n / 2 - breadth(n))),
        "high": lambda n: F.least(n, F.ceil(n / 2 + breadth(n))),
    }
    rows = order_statistics(df, [], columns, ranks)
    return rows.select(
        F.lit("median").alias("metric"), F.lit(confidence).alias("interval_width"), "column_name", "low", "high"
    )


def _tagged(intervals: DataFrame, confidence: float) -> DataFrame:
    return intervals.withColumn("interval_width", F.lit(confidence)).select(*COLUMNS)


def distance_thresholds(
    df: DataFrame,
    column_metrics: Mapping[str, Sequence[str]],
    confidence: float,
    replicates: int,
    key: Column,
    by_counts: bool = True,
) -> list[DataFrame]:
    """How far a resample of the baseline lies from the baseline itself.

    ``by_counts`` resamples value counts; otherwise rows are weighted.
    """
    numbers = [c for c, ms in column_metrics.items() if "ks_test" in ms]
    texts = [c for c, ms in column_metrics.items() if {"chi_squared_test", "tv_distance"} & set(ms)]
    keys, is_number = ["replicate", "column_name"], F.col("num").isNotNull()
    measured = []
    if by_counts:
        base = materialize(value_counts(df, [], list(column_metrics)), "counts")
        reps = materialize(B.resample_counts(base, replicates), "replicates")
        if numbers:
            measured.append(ks_statistics(reps.where(is_number), base.where(is_number), ["column_name"], keys))
        reps, base = reps.where(~is_number), base.where(~is_number)
    else:
        counts = materialize(B.replicate_counts(df, list(column_metrics), replicates, key), "replicates")
        if numbers:
            measured.append(B.replicate_ks(df, numbers, replicates, key, counts))
        valued = counts.where(F.col("column_name").isin(*texts))
        reps = valued.where("n > 0").select(*keys, "txt", "n")
        base = valued.where("replicate = 0").select("column_name", "txt", F.col("rows").alias("n"))
    if texts:
        measured.append(category_tests(reps, base, ["column_name"], keys, False))
    out = []
    for rows in measured:
        for metric, source in DISTANCES.items():
            names = [c for c, ms in column_metrics.items() if metric in ms]
            if source not in rows.columns or not names:
                continue
            values = rows.where(F.col("column_name").isin(names)).select(
                "column_name", F.lit(metric).alias("metric"), F.col(source).alias("value")
            )
            interval = B.percentile_interval(values, confidence, replicates, one_sided=True)
            out.append(_tagged(interval, confidence))
    return out


def delta_thresholds(
    df: DataFrame,
    column_metrics: Mapping[str, Sequence[str]],
    confidence: float,
    replicates: int,
    key: Column,
) -> DataFrame:
    """Two-sided interval of a replicate's metric minus the baseline's own."""
    stats = {c: [DELTA_OF[m] for m in ms] for c, ms in column_metrics.items()}
    reps = B.bootstrap(df, stats, replicates, key)
    one, anchor = F.lit(1), B.anchors(df, stats)
    own = df.agg(
        *[
            B.weighted_stat(s, col(c), one, anchor.get(c)).alias(f"{i}_{s}")
            for i, (c, ss) in enumerate(stats.items())
            for s in ss
        ]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"), F.lit(s).alias("metric"), F.col(f"{i}_{s}").alias("own")
            )
            for i, (c, ss) in enumerate(stats.items())
            for s in ss
        ]
    )
    own = own.select(F.explode(cells).alias("_c")).select("_c.*")
    moved = reps.join(own, ["column_name", "metric"]).select(
        "column_name",
        F.concat("metric", F.lit("_delta")).alias("metric"),
        (F.col("value") - F.col("own")).alias("value"),
    )
    return _tagged(B.percentile_interval(moved, confidence, replicates), confidence)


def generate_thresholds(
    df: DataFrame,
    column_metrics: Mapping[str, Sequence[str]],
    key: Column,
    confidence: float = 0.95,
    replicates: int = 50,
    by_counts: bool = True,
    model_version: str | None = None,
    version_col: str = "model_version",
) -> DataFrame:
    """Thresholds for every (column, metric) pair that applies to the column's type.

    ``model_version`` takes the rows of one version only.  avg by the t interval, median by order statistics, other metrics by bootstrap,
    drift metrics by bootstrap against the baseline; one resampling pass per kind.
    """
    if model_version is not None:
        df = df.where(col(version_col) == model_version)
    types = {f.name: f.dataType for f in df.schema.fields}

    def applies(c: str, metric: str) -> bool:
        number, text = isinstance(types[c], T.NumericType), isinstance(types[c], T.StringType)
        if metric in ("chi_squared_test", "tv_distance"):
            return not number
        if metric == "avg_length":
            return text
        return number or metric in ("percent_null", "percent_null_delta")

    def wanted(names) -> dict[str, list[str]]:
        picked = {
            c: [m for m in ms if m in names and applies(c, m)] for c, ms in column_metrics.items()
        }
        return {c: ms for c, ms in picked.items() if ms}

    known = {"avg", "median", *B.STATS, *DISTANCES, *DELTA_OF}
    unknown = {m for ms in column_metrics.values() for m in ms} - known
    if unknown:
        raise ValueError(f"no threshold method for {sorted(unknown)}")
    parts: list[DataFrame] = []
    if closed := wanted({"avg"}):
        parts.append(mean_interval(df, list(closed), confidence))
    if medians := wanted({"median"}):
        parts.append(median_interval(df, list(medians), confidence))
    if stats := wanted(set(B.STATS) - {"avg"}):
        reps = B.bootstrap(df, stats, replicates, key)
        parts.append(_tagged(B.percentile_interval(reps, confidence, replicates), confidence))
    if deltas := wanted(set(DELTA_OF)):
        parts.append(delta_thresholds(df, deltas, confidence, replicates, key))
    if distances := wanted(set(DISTANCES)):
        parts += distance_thresholds(df, distances, confidence, replicates, key, by_counts)
    if not parts:
        raise ValueError("no metric applies to the given columns")
    return union_all([p.select(*COLUMNS) for p in parts])


def fixed_size_samples(
    df: DataFrame, key: Column, sizes: Sequence[int], trials: int
) -> DataFrame:
    """``size, trial`` and the sampled rows: for each, the ``size`` smallest draws.

    Draws above a cut, which leaves a little more than the largest size of them, are
    dropped before any shuffle, so a trial's window holds about that many rows.  If a
    trial is left with too few, the cut is doubled.
    """
    named = df.withColumn("_k", key.cast("string"))
    drawn = uniforms(named, F.col("_k"), trials, "_u", "trial")
    total, wanted = df.count(), max(sizes)
    cut = min(1.0, (wanted + 6 * wanted**0.5 + 20) / max(total, 1))
    while cut < 1.0:
        left = drawn.where(F.col("_u") < cut).groupBy("trial").count()
        enough = left.where(F.col("count") >= wanted).count()
        if enough == trials:
            break
        cut *= 2
    rank = F.row_number().over(Window.partitionBy("trial").orderBy("_u", "_k"))
    ranked = drawn.where(F.col("_u") < cut).withColumn("_rank", rank).where(F.col("_rank") <= wanted)
    fits = F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s >= F.col("_rank"))
    return ranked.select("*", F.explode(fits).alias("size")).drop("_u", "_k", "_rank")


def coverage(
    df: DataFrame,
    column: str,
    thresholds: DataFrame,
    key: Column,
    sizes: Sequence[int],
    trials: int,
) -> DataFrame:
    """Share of samples whose median lies inside the interval, by sample size.

    A sample has at most ``max(sizes)`` rows, so its exact median is a bounded aggregate.
    """
    samples = fixed_size_samples(df.select(col(column).alias("_x"), key.alias("_id")), F.col("_id"), sizes, trials)
    medians = samples.groupBy("size", "trial").agg(F.median("_x").alias("m"))
    bounds = thresholds.where((F.col("metric") == "median") & (F.col("column_name") == column))
    low, high = bounds.select("low").scalar(), bounds.select("high").scalar()
    inside = F.col("m").between(low, high)
    return medians.groupBy("size").agg(F.avg(inside.cast("int")).alias("coverage"))


def constant_limits(limits: Sequence[tuple[str, str, float | None, float | None]], spark: SparkSession) -> DataFrame:
    """Thresholds given by hand: (metric, column, low, high), either bound may be open."""
    rows = spark.createDataFrame(list(limits), "metric string, column_name string, low double, high double")
    return rows.withColumn("interval_width", F.lit(None).cast("double")).select(*COLUMNS)


def alerts(
    metrics: DataFrame, thresholds: DataFrame, names: Sequence[str], keys: Sequence[str], match: Sequence[str] = ()
) -> DataFrame:
    """Metric rows outside their interval: ``keys, column_name, metric, value, low, high, reason``.

    ``names`` are columns of the metric table.  Thresholds match by metric, column and the
    columns in ``match``, such as a slice or a version; NULLs match NULLs.  A NULL bound is
    open; a value without any bound, and a NULL value, cannot be judged and are reported
    with that reason.
    """
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), col(m).cast("double").alias("value")) for m in names])
    kept = list(dict.fromkeys([*keys, *match]))
    long = metrics.select(*kept, "column_name", F.explode(cells).alias("_c")).select(*kept, "column_name", "_c.*")
    bounds = thresholds.select("metric", "column_name", *match, "low", "high")
    joined = join_null_safe(long, bounds, ["metric", "column_name", *match])
    low, high, value = F.col("low"), F.col("high"), F.col("value")
    reason = (
        F.when(low.isNull() & high.isNull(), "no bounds")
        .when(value.isNull(), "no value")
        .when(value < low, "below")
        .when(value > high, "above")
    )
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(
        *keys, "column_name", "metric", "value", "low", "high", "reason"
    )
