"""Statistics, bootstrap, thresholds and sampling."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.draws import poisson_draws, poisson_of, uniform
from tidemark.functions.stats import chi2_tail, t_quantile
from tidemark.operators import bootstrap as B
from tidemark.operators import sampling, setops
from tidemark.operators import thresholds as TH
from tidemark.operators.counts import value_counts
from tidemark.operators.quality import roc_auc


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(2000).selectExpr("id", "cast(id * id % 101 AS double) AS x", "concat('c', id % 3) AS c")


def test_t_quantile_against_the_engine_library(spark):
    dist = spark._jvm.org.apache.commons.math3.distribution.TDistribution
    for confidence in (0.5, 0.8, 0.95, 0.999):
        exact = {dof: 1e-6 * dist(float(dof)).inverseCumulativeProbability(0.5 + confidence / 2) for dof in range(1, 10)}
        for dof, tol in (exact | {10: 2e-3, 40: 1e-5, 5000: 1e-6}).items():
            got = spark.range(1).select(t_quantile(F.lit(dof), confidence)).first()[0]
            want = dist(float(dof)).inverseCumulativeProbability(0.5 + confidence / 2)
            assert got == pytest.approx(want, abs=tol), (dof, confidence)


def test_intervals_of_eight_rows_at_any_confidence(spark):
    df = spark.createDataFrame([(float(v),) for v in range(8)], "x double")
    mean, median = TH.mean_interval(df, ["x"], 0.8).first(), TH.median_interval(df, ["x"], 0.8).first()
    breadth = 1.414924 * math.sqrt(6) / math.sqrt(8)
    assert (mean.low, mean.high) == (pytest.approx(3.5 - breadth, abs=1e-5), pytest.approx(3.5 + breadth, abs=1e-5))
    assert (median.low, median.high) == (1.0, 6.0)
    bounds = TH.mean_interval(df, ["x"], 0.8)
    metrics = spark.createDataFrame([("w", "x", 1e9)], "w string, column_name string, avg double")
    assert TH.alerts(metrics, bounds, ["avg"], ["w"]).count() == 1


def test_spread_of_large_values(spark):
    df = spark.range(7).select("id", (F.lit(1.7e12) + F.col("id")).alias("x"))
    got = [r.value for r in B.bootstrap(df, {"x": ["stddev"]}, 20, F.col("id")).collect()]
    small = B.bootstrap(df.withColumn("x", F.col("id").cast("double")), {"x": ["stddev"]}, 20, F.col("id"))
    assert sorted(got) == pytest.approx(sorted(r.value for r in small.collect()), rel=1e-6)


def test_poisson_of_any_mean(spark):
    for mean in (0.5, 3.0, 40.0, 99.0, 5000.0):
        drawn = spark.range(4000).select(poisson_of(F.lit(mean), F.md5(F.col("id").cast("string")), 0).alias("k"))
        row = drawn.agg(F.avg("k"), F.var_samp("k"), F.min("k")).first()
        assert row[0] == pytest.approx(mean, abs=5 * math.sqrt(mean / 4000)) and row[2] >= 0
        assert row[1] == pytest.approx(mean, rel=0.15)


def test_chi2_tail_against_closed_forms():
    assert chi2_tail(0, 3) == 1
    for x in (0.1, 2.0, 17.0, 300.0):
        assert chi2_tail(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-10)
        assert chi2_tail(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-10)
        assert chi2_tail(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-9)
    assert 0.4 < chi2_tail(100_000, 100_000) < 0.6


def test_draws_look_like_poisson_and_repeat(spark, numbers):
    drawn = poisson_draws(numbers, F.col("id"), 10)
    row = drawn.agg(F.avg("weight"), F.var_pop("weight"), F.count("*")).first()
    assert row[2] == 20000 and abs(row[0] - 1) < 0.03 and abs(row[1] - 1) < 0.05
    again = poisson_draws(numbers.repartition(5), F.col("id"), 10)
    assert again.exceptAll(drawn).isEmpty()
    u = numbers.select(uniform(F.col("id"), 1).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= u[0] and u[1] < 1 and abs(u[2] - 0.5) < 0.03


def test_weighted_equals_copied_bootstrap(numbers):
    a = B.bootstrap(numbers, {"x": ["avg", "stddev"]}, 20, F.col("id")).collect()
    b = {r.replicate: r for r in B.bootstrap_by_copies(numbers, "x", 20, F.col("id")).collect()}
    for r in a:
        assert r.value == pytest.approx(b[r.replicate][r.metric])


def test_resampling_counts_has_the_same_distribution(numbers):
    counts = value_counts(numbers, [], ["x"])
    reps = B.resample_counts(counts, 200)
    means = reps.groupBy("replicate").agg((F.sum(F.col("num") * F.col("n")) / F.sum("n")).alias("m"))
    spread = means.agg(F.stddev("m")).first()[0]
    rows = B.bootstrap(numbers, {"x": ["avg"]}, 200, F.col("id")).agg(F.stddev("value")).first()[0]
    assert spread == pytest.approx(rows, rel=0.25)


def test_bootstrap_plan_has_no_python(numbers):
    plan = B.bootstrap(numbers, {"x": ["avg"]}, 50, F.col("id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") == 1


def test_percentile_interval_ranks(spark):
    reps = spark.range(100).selectExpr("'m' AS metric", "'c' AS column_name", "cast(id + 1 AS double) AS value")
    two = B.percentile_interval(reps, 0.95, 100).first()
    assert (two.low, two.high) == (2.0, 98.0)
    one = B.percentile_interval(reps, 0.95, 100, one_sided=True).first()
    assert (one.low, one.high) == (0.0, 95.0)


def test_median_interval_of_few_rows_stays_inside(spark):
    df = spark.createDataFrame([(float(v),) for v in (5, 1, 3)] + [(None,)], "x double")
    row = TH.median_interval(df, ["x"], 0.95).first()
    assert (row.low, row.high) == (1.0, 5.0)


def test_mean_interval_of_one_row_is_null(spark):
    row = TH.mean_interval(spark.createDataFrame([(1.0,)], "x double"), ["x"], 0.95).first()
    assert row.low is None and row.high is None


def test_generated_thresholds_skip_what_does_not_apply(numbers):
    rows = TH.generate_thresholds(
        numbers,
        {"x": ["avg", "avg_length", "stddev"], "c": ["ks_test", "tv_distance", "avg_length"]},
        F.col("id"),
        replicates=40,
    ).collect()
    got = {(r.column_name, r.metric) for r in rows}
    assert got == {("x", "avg"), ("x", "stddev"), ("c", "tv_distance"), ("c", "avg_length")}
    assert all(r.low <= r.high for r in rows)
    with pytest.raises(ValueError):
        TH.generate_thresholds(numbers, {"x": ["unheard_of"]}, F.col("id"))


def test_median_coverage_is_high_for_same_size(numbers):
    bounds = TH.median_interval(numbers.where("id < 200"), ["x"], 0.95)
    got = TH.coverage(numbers, "x", bounds, F.col("id"), [200, 1000], 40)
    shares = {r.size: r.coverage for r in got.collect()}
    assert set(shares) == {200, 1000} and shares[1000] >= 0.8


def test_large_samples_are_cut_before_the_shuffle(spark):
    df = spark.range(60000)
    samples = TH.fixed_size_samples(df, F.col("id"), [200, 2000], 3)
    plan = samples._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert "_u" in below and "<" in below[below.index("Filter") :]
    sizes = {(r.trial, r["size"]): r["count"] for r in samples.groupBy("trial", "size").count().collect()}
    assert sizes == {(t, s): s for t in range(3) for s in (200, 2000)}


def test_alerts(spark):
    metrics = spark.createDataFrame([("w1", "x", 5.0), ("w2", "x", 9.0), ("w3", "x", None)], "w string, column_name string, avg double")
    bounds = spark.createDataFrame([("avg", 0.95, "x", 4.0, 6.0)], "metric string, interval_width double, column_name string, low double, high double")
    got = {r.w: r.reason for r in TH.alerts(metrics, bounds, ["avg"], ["w"]).collect()}
    assert got == {"w2": "above", "w3": "no value"}
    none = bounds.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    assert {r.reason for r in TH.alerts(metrics, none, ["avg"], ["w"]).collect()} == {"no bounds"}
    open_ = TH.constant_limits([("avg", "x", 6.0, None)], spark)
    assert [r.w for r in TH.alerts(metrics.where("avg is not null"), open_, ["avg"], ["w"]).collect()] == ["w1"]


def test_split_is_disjoint_and_whole(numbers):
    parts = sampling.split(numbers, [0.5, 0.25, 0.25], seed=3)
    sizes = [p.count() for p in parts]
    assert sum(sizes) == 2000 and abs(sizes[0] - 1000) < 120
    assert setops.union_balanced(parts).exceptAll(numbers).isEmpty()


def test_sample_sizes(spark, numbers):
    assert sampling.sample_rows(numbers, 17).count() == 17
    assert sampling.sample_rate(0, 10) == 1.0 and sampling.sample_rate(5, 10) == 1.0
    assert sampling.sample_about(spark.range(0), 10).count() == 0


def test_balanced_union_is_shallow(spark):
    frames = [spark.range(1).selectExpr(f"{i} AS id") for i in range(9)]
    united = setops.union_balanced(frames)
    assert sorted(r.id for r in united.collect()) == list(range(9))
    with pytest.raises(ValueError):
        setops.union_balanced([])


def test_auc_against_pairs(spark):
    rows = [(s, y) for s, y in zip([3, 1, 4, 1, 5, 9, 2, 6, 5, 3], [1, 0, 1, 0, 1, 1, 0, 0, 1, 1])]
    df = spark.createDataFrame([(float(s), bool(y)) for s, y in rows], "s double, y boolean")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert roc_auc(df, "s", "y").first().auc == pytest.approx(want)


def test_replicates_of_rows_move_each_row_once(spark, monkeypatch):
    """Ranges that cut a hot value, NaN, zeros of both signs, NULLs; against the draws laid out."""
    monkeypatch.setattr(B, "RANGE_ROWS", 40)
    value = "CASE WHEN id % 3 = 0 THEN 7.0D WHEN id % 50 = 1 THEN double('NaN') WHEN id % 50 = 4 THEN -0.0D WHEN id % 7 = 0 THEN 0.0D WHEN id % 11 = 0 THEN NULL ELSE id * 37 % 101 END"
    df = spark.range(600).selectExpr("id", f"{value} AS x", "id % 5 AS k", "CASE WHEN id % 4 > 0 THEN concat('c', id % 3) END AS c").repartition(3)
    counts = B.replicate_counts(df, ["x", "k", "c"], 10, F.col("id")).cache()
    assert counts.where("column_name = 'x'").count() == 10  # not a row for every value
    got = {(r.column_name, r.replicate): r.ks_statistic for r in B.replicate_ks(df, ["x", "k"], 10, F.col("id"), counts).collect()}
    drawn = poisson_draws(df, F.col("id"), 10).collect()
    for c in ("x", "k"):
        for r in range(10):
            rows = [(v.weight, math.inf if math.isnan(v[c]) else v[c]) for v in drawn if v.replicate == r and v[c] is not None]
            total = sum(w for w, _ in rows)
            far = max(abs(sum(w for w, v in rows if v <= at) / total - sum(v <= at for _, v in rows) / len(rows)) for _, at in rows)
            assert got[c, r] == pytest.approx(far, abs=1e-12), (c, r)
    texts = {(r.replicate, r.txt): (r.rows, r.n) for r in counts.where("column_name = 'c' AND txt IS NOT NULL").collect()}
    want = {}
    for v in drawn:
        if v.c is not None:
            rows, n = want.get((v.replicate, v.c), (0, 0))
            want[v.replicate, v.c] = rows + 1, n + v.weight
    assert texts == want
