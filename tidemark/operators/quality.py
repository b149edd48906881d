"""Model quality: classification, regression, confusion counts, ROC."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col
from tidemark.operators.running import running_totals
from tidemark.session import materialize
from tidemark.spec import Analysis, InferenceLog


def quality_metrics(
    analysis: Analysis, types: Mapping[str, T.DataType], column: Callable[[str], Column] = col
) -> dict[str, Column]:
    """Aggregates for the table-level row; rows without a label do not count.

    ``types`` are those of the table's columns; ``column`` refers to one of them.
    """
    if not isinstance(analysis, InferenceLog) or analysis.label_col is None:
        return {}
    pred, label = column(analysis.prediction_col), column(analysis.label_col)
    both = label.isNotNull() & pred.isNotNull()
    if analysis.problem_type == "classification":
        # Numbers are compared as numbers, so 1.0 hits 1; anything else as text.
        sides = (analysis.prediction_col, analysis.label_col)
        kind = "double" if all(isinstance(types[c], T.NumericType) for c in sides) else "string"
        hit = (pred.cast(kind) == label.cast(kind)).cast("int")
        return {"accuracy_score": F.avg(F.when(both, hit))}
    error = pred.cast("double") - label.cast("double")
    mse = F.avg(F.when(both, error * error))
    return {
        "mean_squared_error": mse,
        "root_mean_squared_error": F.sqrt(mse),
        "mean_absolute_error": F.avg(F.when(both, F.abs(error))),
    }


def confusion_counts(df: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    labelled = df.where(col(label).isNotNull() & col(prediction).isNotNull())
    return labelled.groupBy(*keys, label, prediction).agg(F.count("*").alias("n"))


def precision_recall_f1(
    df: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Binary scores of boolean columns; a score without a denominator is 0."""
    y, p = col(label), col(prediction)
    tp, fp, fn = F.count_if(y & p), F.count_if(~y & p), F.count_if(y & ~p)

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return df.where(y.isNotNull() & p.isNotNull()).groupBy(*keys).agg(
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def _score_counts(scored: DataFrame, score: str, label: str, keys: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score, ordered by descending score."""
    usable = scored.where(col(score).isNotNull() & col(label).isNotNull())
    return usable.groupBy(*keys, (-col(score).cast("double")).alias("_down")).agg(
        F.count_if(col(label)).alias("pos"), F.count_if(~col(label)).alias("neg")
    )


def roc_curve(scored: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score: ``threshold, fpr, tpr`` plus the step into it.

    Positives and negatives are accumulated in chunks of the score range, so no group
    has to be sorted in one task.
    """
    points = materialize(_score_counts(scored, score, label, keys), "scores")
    curve = running_totals(points, keys, "_down", ["pos", "neg"])
    return curve.select(
        *keys,
        (-F.col("_down")).alias("threshold"),
        (F.col("neg_running") / F.nullif(F.col("neg_total"), F.lit(0))).alias("fpr"),
        (F.col("pos_running") / F.nullif(F.col("pos_total"), F.lit(0))).alias("tpr"),
        *["pos", "neg", "pos_running", "pos_total", "neg_total"],
    )


def roc_auc(scored: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the curve by trapezoids.

    The trapezoid ending at a point spans ``neg`` on one axis and has the mean height
    ``pos_running - pos/2`` on the other, so no look at the previous point is needed.
    """
    curve = roc_curve(scored, score, label, keys)
    area = F.sum(F.col("neg") * (F.col("pos_running") - F.col("pos") / 2))
    return curve.groupBy(*keys).agg(
        (area / F.nullif(F.max("pos_total") * F.max("neg_total"), F.lit(0))).alias("auc")
    )
