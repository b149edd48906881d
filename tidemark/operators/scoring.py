"""Fitting, parameter search and batch scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forest_pipeline(
    categoricals: Sequence[str], numerics: Sequence[str], label: str, **forest
) -> Pipeline:
    """One-hot categories and plain numbers into a random forest."""
    indexed = [f"{c}_index" for c in categoricals]
    encoded = [f"{c}_onehot" for c in categoricals]
    return Pipeline(
        stages=[
            StringIndexer(inputCols=list(categoricals), outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, handleInvalid="keep"),
            VectorAssembler(inputCols=[*encoded, *numerics], outputCol="_features", handleInvalid="keep"),
            RandomForestRegressor(
                featuresCol="_features", labelCol=label, predictionCol="prediction", **forest
            ),
        ]
    )


def fit(df: DataFrame, categoricals, numerics, label: str, **forest) -> PipelineModel:
    return forest_pipeline(categoricals, numerics, label, **forest).fit(df)


def search(
    df: DataFrame,
    categoricals: Sequence[str],
    numerics: Sequence[str],
    label: str,
    depths: Sequence[int],
    trees: Sequence[int],
    seed: int = 42,
    parallelism: int = 3,
):
    """Best forest by root mean squared error on a tenth held out.

    Returns the fitted search: ``bestModel`` and ``validationMetrics`` per grid point.
    """
    pipeline = forest_pipeline(categoricals, numerics, label, seed=seed)
    forest = pipeline.getStages()[-1]
    grid = (
        ParamGridBuilder().addGrid(forest.maxDepth, list(depths)).addGrid(forest.numTrees, list(trees)).build()
    )
    evaluator = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="rmse")
    return TrainValidationSplit(
        estimator=pipeline, estimatorParamMaps=grid, evaluator=evaluator, trainRatio=0.9,
        parallelism=parallelism, seed=seed,
    ).fit(df)


def score(model: Transformer, df: DataFrame, version: str) -> DataFrame:
    """The rows with ``prediction`` and ``model_version``; helper columns are left out."""
    scored = model.transform(df)
    return scored.select(*df.columns, "prediction").withColumn("model_version", F.lit(version))


def baseline_log(models: dict[str, Transformer], train: DataFrame) -> DataFrame:
    """Training rows scored by every model version, for use as a baseline."""
    from tidemark.operators.setops import union_all

    return union_all([score(m, train, v) for v, m in models.items()])
