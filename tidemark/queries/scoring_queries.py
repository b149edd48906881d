"""Fitting and scoring.

A forest's numbers are its own, so what SQL can say of every row is compared: which rows
are scored, and that predictions lie within the labels and beat their mean.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import scoring as O
from tidemark.queries.registry import query, table
from tidemark.session import scratch_path
from tidemark.sources.tables import read_parquet, write_table

CATEGORICALS, NUMERICS, LABEL = ["p_brand"], ["p_size", "key_rest"], "p_retailprice"


def parts(spark, sf):
    """Parts with a feature the price depends on."""
    return table(spark, sf, "part").withColumn("key_rest", (F.col("p_partkey") % 1000).cast("double"))


@query(
    "o1_fit",
    "SELECT count(*) AS n, sum(p_partkey)::BIGINT AS keys, true AS within_labels, true AS beats_mean FROM part",
)
def fit(spark, sf):
    model = O.fit(parts(spark, sf), CATEGORICALS, NUMERICS, LABEL, numTrees=5, maxDepth=4, seed=1)
    scored = O.score(model, parts(spark, sf), "1")
    error = F.sqrt(F.avg((F.col("prediction") - F.col(LABEL)) ** 2))
    return scored.agg(
        F.count("*").alias("n"),
        F.sum("p_partkey").alias("keys"),
        ((F.min("prediction") >= F.min(LABEL)) & (F.max("prediction") <= F.max(LABEL))).alias("within_labels"),
        (error < F.stddev(LABEL)).alias("beats_mean"),
    )


@query(
    "o2_parameter_search",
    "SELECT count(*) AS n, 9 AS candidates, true AS beats_mean, true AS best_is_least FROM part",
)
def parameter_search(spark, sf):
    """Nine candidates, three at a time, judged on a tenth held out; the best scores all rows."""
    found = O.search(parts(spark, sf), CATEGORICALS, NUMERICS, LABEL, [2, 3, 4], [2, 3, 5])
    grid, errors = found.getEstimatorParamMaps(), found.validationMetrics
    best = {p.name: v for p, v in grid[errors.index(min(errors))].items()}
    forest = found.bestModel.stages[-1]
    kept = best == {"maxDepth": forest.getOrDefault("maxDepth"), "numTrees": forest.getOrDefault("numTrees")}
    error = F.sqrt(F.avg((F.col("prediction") - F.col(LABEL)) ** 2))
    return O.score(found.bestModel, parts(spark, sf), "1").agg(
        F.count("*").alias("n"),
        F.lit(len(errors)).alias("candidates"),
        (error < F.stddev(LABEL)).alias("beats_mean"),
        F.lit(kept).alias("best_is_least"),
    )


@query("o3_batch_scoring", "SELECT p_partkey, '1' AS model_version, true AS within_labels FROM part")
def batch_scoring(spark, sf):
    """Two halves scored by a model of all rows and appended to one table."""
    train = parts(spark, sf)
    model = O.fit(train, CATEGORICALS, NUMERICS, LABEL, numTrees=3, seed=1)
    path = scratch_path(spark, "scored")
    for half in (0, 1):
        write_table(O.score(model, train.where(f"p_partkey % 2 = {half}"), "1"), path)
    low, high = train.agg(F.min(LABEL), F.max(LABEL)).first()
    within = F.col("prediction").between(low, high)
    return read_parquet(spark, path).select("p_partkey", "model_version", within.alias("within_labels"))


@query(
    "o4_baseline_per_version",
    "SELECT unnest(['1', '2']) AS model_version, * FROM (SELECT count(*) AS n, min(p_partkey) AS first_key FROM part)",
)
def baseline_per_version(spark, sf):
    """The training rows scored by every version, as one baseline table."""
    train = parts(spark, sf)
    models = {str(v): O.fit(train, CATEGORICALS, NUMERICS, LABEL, numTrees=2, maxDepth=2 + v, seed=v) for v in (1, 2)}
    path = scratch_path(spark, "baseline")
    write_table(O.baseline_log(models, train), path, "overwrite")
    return read_parquet(spark, path).groupBy("model_version").agg(
        F.count("prediction").alias("n"), F.min("p_partkey").alias("first_key")
    )


@query("m5_model_as_column", "SELECT count(*) AS n, count(*) AS n_scored FROM part")
def model_as_column(spark, sf):
    model = O.fit(parts(spark, sf), CATEGORICALS, NUMERICS, LABEL, numTrees=2, seed=3)
    scored = O.score(model, parts(spark, sf), "3")
    return scored.agg(F.count("*").alias("n"), F.count("prediction").alias("n_scored"))
