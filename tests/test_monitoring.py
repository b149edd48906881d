"""Windows, profiles, drift and their invariants on small frames."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark import GenericTable, InferenceLog, Metric, MonitorSpec, TimeSeries
from tidemark.operators import drift as D
from tidemark.operators import profile as P
from tidemark.operators import windows as W
from tidemark.operators.counts import class_counts, value_counts
from tidemark.operators.running import running_by_group, running_totals, value_at_rank
from tidemark.plans import monitors as M
from tidemark.plans import refresh as R
from tidemark.session import materialize, scratch_scope
from tidemark.sources.tables import exists
from tidemark.spec import BASELINE


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize(
    "text, start, end",
    [
        ("30 minutes", "2024-05-15 10:30:00", "2024-05-15 11:00:00"),
        ("1 day", "2024-05-15 00:00:00", "2024-05-16 00:00:00"),
        ("1 week", "2024-05-13 00:00:00", "2024-05-20 00:00:00"),
        ("3 months", "2024-04-01 00:00:00", "2024-07-01 00:00:00"),
        ("1 year", "2024-01-01 00:00:00", "2025-01-01 00:00:00"),
    ],
)
def test_window_bounds(spark, text, start, end):
    df = spark.sql("SELECT timestamp'2024-05-15 10:47:11' AS ts")
    row = df.select(W.window_of(F.col("ts"), text).alias("w")).select("w.*").first()
    assert (str(row.start), str(row.end)) == (start, end)


def test_window_before_epoch_and_null(spark):
    df = spark.sql("SELECT timestamp'1969-12-31 23:10:00' AS ts UNION ALL SELECT NULL")
    rows = W.assign_windows(df, "ts", ["1 hour", "1 month"]).collect()
    assert sorted(str(r.window.start) for r in rows) == ["1969-12-01 00:00:00", "1969-12-31 23:00:00"]


@pytest.mark.parametrize("text", ["week", "0 days", "1 fortnight", ""])
def test_bad_granularity(text):
    with pytest.raises(ValueError):
        W.parse_granularity(text)


def test_specs_are_checked():
    with pytest.raises(ValueError):
        MonitorSpec(TimeSeries("ts"))
    with pytest.raises(ValueError):
        MonitorSpec(GenericTable(), ("1 day",))
    with pytest.raises(ValueError):
        MonitorSpec(InferenceLog("ts", "p", "v", "ranking"), ("1 day",))
    with pytest.raises(ValueError):
        Metric("window", "m", ("a",), "1")


def test_profile_of_nulls_single_row_and_odd_names(spark):
    df = spark.createDataFrame([(None, None), (0.0, "xy")], "`capital-gain` double, `a.b` string")
    rows = {r.column_name: r for r in P.profile(df, MonitorSpec(exact=True), as_of=day(0)).collect()}
    gain, text, whole = rows["capital-gain"], rows["a.b"], rows[":table"]
    assert (gain["count"], gain.num_nulls, gain.distinct_count, gain.median) == (2, 1, 1, 0.0)
    assert gain.percent_zeros == 1.0 and gain.stddev is None
    assert text.avg_length == 2.0 and text.avg is None and text.median is None
    assert whole.non_null_columns == 2 and whole["count"] == 2


def test_long_values_beyond_double_are_distinct(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,)], "id long")
    row = P.profile(df, MonitorSpec(exact=True), as_of=day(0)).where("column_name = 'id'").first()
    assert row.distinct_count == 2


def test_slice_counts_add_up(spark):
    df = spark.range(100).selectExpr("id % 7 AS k", "if(id % 5 = 0, NULL, id) AS v")
    spec = MonitorSpec(slicing_exprs=("k", "v > 50"), columns=("v",), exact=False)
    rows = P.profile(df, spec, as_of=day(0)).where("column_name = 'v'").collect()
    total = next(r["count"] for r in rows if r.slice_key is None)
    for key in ("k", "v > 50"):
        assert sum(r["count"] for r in rows if r.slice_key == key) == total
    assert any(r.slice_key == "v > 50" and r.slice_value is None for r in rows)


def test_exact_and_sketch_profiles_agree(spark):
    df = spark.range(1000).selectExpr("id % 10 AS a", "cast(id AS string) AS s")
    exact = {r.column_name: r for r in P.profile(df, MonitorSpec(exact=True), as_of=day(0)).collect()}
    rough = {
        r.column_name: r for r in P.profile(df, MonitorSpec(exact=False), as_of=day(0)).collect()
    }
    assert exact["a"].median == rough["a"].median == 4.0
    assert exact["s"].distinct_count == 1000
    assert abs(rough["s"].distinct_count - 1000) < 60


def _counts(spark, values, **keys):
    rows = [(float(v),) for v in values]
    df = spark.createDataFrame(rows, "num double").groupBy("num").agg(F.count("*").alias("n"))
    return df.withColumns({k: F.lit(v) for k, v in keys.items()})


def _brute_ks(a, b):
    points = sorted(set(a) | set(b))
    return max(abs(sum(x <= p for x in a) / len(a) - sum(x <= p for x in b) / len(b)) for p in points)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ks_against_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [rng.randint(0, 30) for _ in range(60)]
    windows = {w: [rng.randint(0, 10 + 10 * w) for _ in range(20 + 10 * w)] for w in (1, 2, 3)}
    cur = None
    for w, values in windows.items():
        part = _counts(spark, values, k="x", w=w)
        cur = part if cur is None else cur.unionByName(part)
    got = D.ks_statistics(cur, _counts(spark, base, k="x"), ["k"], ["k", "w"]).collect()
    assert {r.w: round(r.ks_statistic, 12) for r in got} == {
        w: round(_brute_ks(v, base), 12) for w, v in windows.items()
    }


def test_ks_disjoint_identical_and_hot_value(spark):
    base = _counts(spark, [5] * 1000 + [1, 2, 3], k="x")
    same = D.ks_statistics(base, base, ["k"], ["k"]).first()
    assert same.ks_statistic == 0 and same.ks_pvalue == 1
    far = D.ks_statistics(_counts(spark, [9, 10], k="x"), base, ["k"], ["k"]).first()
    assert far.ks_statistic == 1 and far.ks_pvalue < 0.05
    # No base rows for the key: no drift row.
    assert D.ks_statistics(_counts(spark, [1], k="y"), base, ["k"], ["k"]).count() == 0


def _brute_chi(a, b):
    names = set(a) | set(b)
    na, nb = sum(a.values()), sum(b.values())
    chi = 0.0
    for x in names:
        both = a.get(x, 0) + b.get(x, 0)
        for got, n in ((a.get(x, 0), na), (b.get(x, 0), nb)):
            want = both * n / (na + nb)
            chi += (got - want) ** 2 / want
    tv = 0.5 * sum(abs(a.get(x, 0) / na - b.get(x, 0) / nb) for x in names)
    return chi, len(names) - 1, tv


def test_category_tests_with_missing_categories(spark):
    a, b = {"p": 7, "q": 3, "only a": 2}, {"p": 4, "q": 9, "only b": 5, "rest": 1}

    def frame(d):
        return spark.createDataFrame([("k", x, n) for x, n in d.items()], "k string, txt string, n long")

    row = D.category_tests(frame(a), frame(b), ["k"], ["k"]).first()
    chi, dof, tv = _brute_chi(a, b)
    assert row.chi_squared_statistic == pytest.approx(chi)
    assert (row.chi_squared_dof, row.tv_distance) == (dof, pytest.approx(tv))
    assert 0 < row.chi_squared_pvalue < 1


def test_classes_bound_the_total_variation(spark):
    rng = random.Random(5)
    texts = [[f"t{int(rng.paretovariate(0.4)) % 3000 + shift}" for _ in range(2000)] for shift in (0, 400)]
    rows = [("k", side, t) for side, part in enumerate(texts) for t in part] + [("k", 0, None)]
    df = spark.createDataFrame(rows, "k string, side int, c string")
    _, _, tv = _brute_chi(*[{x: part.count(x) for x in set(part)} for part in texts])
    widths = []
    for classes in (1, 16, 256, 2**20):
        cur, base = (class_counts(df.where(f"side = {s}"), ["k"], ["c"], classes) for s in (0, 1))
        assert cur.count() <= classes and cur.agg(F.sum("n")).first()[0] == 2000
        r = D.category_tests(cur, base, ["k", "column_name"], ["k", "column_name"]).first()
        assert r.tv_distance <= tv + 1e-9 and tv <= r.tv_distance_max + 1e-9
        widths.append(r.tv_distance_max - r.tv_distance)
    assert widths == sorted(widths, reverse=True) and widths[-1] < 1e-6


def test_counts_of_a_unique_text_are_bounded(spark):
    df = spark.range(5000).selectExpr("concat('id', id) AS c", "CAST(NULL AS STRING) AS d")
    spec = MonitorSpec(category_classes=64)
    old = R.run_stages(df, spec, as_of=day(0), log_type=BASELINE)
    stage = R.run_stages(df.where("c < 'id3'"), spec, as_of=day(1))
    assert stage.counts.count() <= 64 and old.counts.count() <= 64
    row = R.drift_stage(stage, spec, old).where("column_name = 'c'").first()
    share = df.where("c < 'id3'").count() / 5000
    assert row.tv_distance <= 1 - share <= row.tv_distance_max
    empty = R.run_stages(df.where("false"), spec, as_of=day(1))
    assert empty.counts.count() == 0 and R.drift_stage(empty, spec, old).where("tv_distance IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        MonitorSpec(category_classes=0)


def test_pvalue_of_sketches_allows_for_their_error(spark):
    rows = [(float(i % 1000), d) for d in (0, 1) for i in range(20000)]
    df = spark.createDataFrame([(x, day(d)) for x, d in rows], "x double, ts timestamp")
    drift = R.monitor(df, MonitorSpec(TimeSeries("ts"), ("1 day",), columns=("x",))).drift
    assert drift.where("column_name = 'x'").first().ks_pvalue == 1


def test_running_totals_over_skewed_groups(spark):
    rng = random.Random(0)
    rows = [("hot", float(i), rng.randint(1, 5)) for i in range(3000)] + [(None, 1.0, 2), (None, 0.5, 1)]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    got = {(r.g, r.v): r.n_running for r in running_totals(df, ["g"], "v", ["n"]).collect()}
    total = 0
    for g, v, n in rows[:3000]:
        total += n
        assert got[(g, v)] == total
    assert got[(None, 0.5)] == 1 and got[(None, 1.0)] == 3
    middle = value_at_rank(df.where("g = 'hot'"), ["g"], "v", "n", {"m": F.ceil(F.col("n_total") / 2)})
    flat = sorted(v for _, v, n in rows[:3000] for _ in range(n))
    assert middle.first().m == flat[(len(flat) + 1) // 2 - 1]


def _log(spark):
    rows = [(day(d), float(d * 10 + i), "ab"[i % 2], str(i % 2)) for d in range(4) for i in range(10) if d != 2 or i < 0]
    return spark.createDataFrame(rows, "ts timestamp, x double, c string, v string")


def test_previous_window_is_the_last_existing_one(spark):
    spec = MonitorSpec(TimeSeries("ts"), ("1 day",), columns=("x", "c"))
    result = R.monitor(_log(spark), spec)
    rows = result.drift.where("column_name = 'x'").orderBy("window").collect()
    assert [(r.window_cmp.start, r.window.start) for r in rows] == [(day(0), day(1)), (day(1), day(3))]
    assert [r.avg_delta for r in rows] == [10.0, 20.0]
    assert all(r.ks_statistic == 1.0 for r in rows)


def test_baseline_without_a_slice_gives_no_row(spark):
    spec = MonitorSpec(TimeSeries("ts"), ("1 day",), ("c",), columns=("x",))
    base = _log(spark).where("c = 'a'")
    drift = R.monitor(_log(spark), spec, base).drift.where("drift_type = 'BASELINE' AND column_name = 'x'")
    seen = {(r.slice_key, r.slice_value) for r in drift.collect()}
    assert seen == {(None, None), ("c", "a")}


def test_injected_drift_is_seen_on_the_changed_columns_only(spark):
    base = spark.range(2000).selectExpr("id % 20 AS size", "concat('p', id % 4) AS policy", "id % 9 AS beds")
    moved = base.selectExpr("1L AS size", "if(policy = 'p0', 'p9', policy) AS policy", "beds")
    old = R.run_stages(base, MonitorSpec(), as_of=day(0), log_type=BASELINE)
    drift = R.drift_stage(R.run_stages(moved, MonitorSpec(), as_of=day(1)), MonitorSpec(), old)
    rows = {r.column_name: r for r in drift.collect()}
    assert rows["size"].ks_statistic > 0.85 and rows["size"].ks_pvalue < 1e-6
    assert rows["policy"].tv_distance == pytest.approx(0.25) and rows["policy"].chi_squared_pvalue < 1e-6
    assert rows["beds"].ks_statistic <= D.SKETCH_ERROR and rows["beds"].ks_pvalue == 1


def test_incremental_refresh_equals_backfill(spark):
    spec = MonitorSpec(TimeSeries("ts"), ("1 day", "1 week"), ("c",), columns=("x", "c"))
    new = _log(spark)
    late = spark.createDataFrame([(day(2), 7.0, "a", "0")], new.schema)
    old, new = new.where("x < 31"), new.unionByName(late)
    before = R.monitor(old, spec)
    touched = R.touched_windows(R.changed_rows(old, new), spec)
    analysis = R.refresh_analysis(new, spec, before.analysis, touched)
    drift = R.refresh_drift(new, spec, before.drift, analysis, touched)
    full = R.monitor(new, spec)

    def rows(df):
        return sorted(map(repr, df.select(sorted(df.columns)).collect()))

    assert rows(analysis) == rows(full.analysis)
    assert rows(drift) == rows(full.drift)


def test_windows_that_lose_their_rows_disappear(spark):
    spec = MonitorSpec(TimeSeries("ts"), ("1 day",), columns=("x",))
    old = _log(spark)
    new = old.where(F.col("ts") != F.lit(day(1)))
    before = R.monitor(old, spec)
    touched = R.touched_windows(R.changed_rows(old, new), spec)
    analysis = R.refresh_analysis(new, spec, before.analysis, touched)
    drift = R.refresh_drift(new, spec, before.drift, analysis, touched)
    assert {r.window.start for r in analysis.collect()} == {day(0), day(3)}
    assert {(r.window_cmp.start, r.window.start) for r in drift.collect()} == {(day(0), day(3))}


def test_changed_rows_counts_copies(spark):
    old = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    new = spark.createDataFrame([(1,), (3,), (None,)], "a int")
    got = {r.a: r._change for r in R.changed_rows(old, new).collect()}
    assert got == {1: -1, 2: -1, 3: 1, None: 1}


def test_merged_base_equals_whole(spark):
    spec = MonitorSpec(TimeSeries("ts"), ("1 week",), columns=("x", "c"))
    df = _log(spark)
    parts = R.aggregate_base(df.where("x < 12"), spec).unionByName(R.aggregate_base(df.where("x >= 12"), spec))
    merged = R.finish_aggregate_base(R.merge_aggregate_base(parts)).where("column_name = 'x'").first()
    whole = P.profile(df, spec).where("column_name = 'x'").first()
    for name in ("count", "min", "max", "distinct_count"):
        assert merged[name] == whole[name]
    assert merged.avg == pytest.approx(whole.avg) and merged.stddev == pytest.approx(whole.stddev)


def test_profile_plan_has_no_python_and_one_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    spec = MonitorSpec(TimeSeries("l_shipdate"), ("1 month",), ("l_returnflag",), columns=("l_tax",), exact=False)
    plan = P.profile(df, spec)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("FileScan") == 1
    assert "l_comment" not in plan and "l_extendedprice" not in plan


def test_merged_spread_of_large_values(spark):
    rows = spark.range(7).select(F.lit(0).alias("k"), (F.lit(1_700_000_000_000) + F.col("id")).alias("x"))
    spec = MonitorSpec(columns=("x",))
    parts = R.aggregate_base(rows.where("x % 2 = 0"), spec).unionByName(R.aggregate_base(rows.where("x % 2 = 1"), spec))
    both = parts.withColumn("window", F.lit(None).cast(parts.schema["window"].dataType))
    row = R.finish_aggregate_base(R.merge_aggregate_base(both)).where("column_name = 'x'").first()
    assert row["stddev"] == pytest.approx(math.sqrt(28 / 6), rel=1e-9) and row["count"] == 7


def test_no_window_spans_a_group_of_data_rows(spark):
    """Windows over rows are cut by chunk; the others see a row per group and chunk."""
    rows = spark.range(5000).selectExpr("id % 3 AS k", "cast(id AS double) AS num", "1L AS n")
    plan = running_by_group(rows, ["k"], "num", ["n"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_chunk" in line for line in windows)


def test_refresh_finds_what_changed(spark, tmp_path):
    days = spark.range(300).selectExpr("timestamp'2024-01-01' + make_interval(0,0,0,cast(id % 10 AS int)) AS ts", "id % 7 AS v")
    days.createOrReplaceTempView("refreshed")
    monitors = M.Monitors(spark, str(tmp_path))
    monitors.create_or_update("refreshed", MonitorSpec(TimeSeries("ts"), ("1 day",)), baseline_table_name="refreshed")
    before = {r.window.start: r["avg"] for r in monitors.analysis("refreshed").where("column_name = 'v' AND log_type = 'INPUT'").collect()}
    days.where("NOT (day(ts) = 4 AND v > 3) AND day(ts) != 9").createOrReplaceTempView("refreshed")
    monitors.refresh("refreshed")
    after = {r.window.start: r["avg"] for r in monitors.analysis("refreshed").where("column_name = 'v' AND log_type = 'INPUT'").collect()}
    assert {k.day for k in before if before[k] != after.get(k)} == {4, 9} and len(after) == 9
    gone = monitors.drift("refreshed").where("drift_type = 'CONSECUTIVE' AND day(window_cmp.start) = 8").select("window.start").distinct()
    assert [r[0].day for r in gone.collect()] == [10]
    full = M.Monitors(spark, str(tmp_path / "full"))
    full.create_or_update("refreshed", MonitorSpec(TimeSeries("ts"), ("1 day",)), baseline_table_name="refreshed")
    keys = ["log_type", "window", "column_name", "count", "avg", "median"]
    assert monitors.analysis("refreshed").select(keys).exceptAll(full.analysis("refreshed").select(keys)).isEmpty()
    keys = ["drift_type", "window", "window_cmp", "column_name", "avg_delta", "ks_statistic"]
    assert monitors.drift("refreshed").select(keys).exceptAll(full.drift("refreshed").select(keys)).isEmpty()


def test_scan_ranges_join_neighbours(spark):
    rows = spark.range(20).where("id NOT IN (3, 4, 11)").selectExpr(
        "named_struct('start', timestamp_seconds(id * 60), 'end', timestamp_seconds(id * 60 + 60)) AS window"
    )
    got = [(int(a.timestamp()) // 60, int(b.timestamp()) // 60) for a, b in R.scan_ranges(rows)]
    assert sorted(got) == [(0, 3), (5, 11), (12, 20)]
    assert len(R.scan_ranges(rows, 2)) == 2 and R.scan_ranges(rows.limit(0)) == []


def test_scratch_scope_removes_its_tables(spark):
    with scratch_scope(spark):
        frame = materialize(spark.range(3), "inside")
        path = frame.inputFiles()[0].rsplit("/", 1)[0]
        assert exists(spark, path)
    assert not exists(spark, path)


def test_ks_over_many_ranges(spark, monkeypatch):
    """Values in several ranges, ties and NaN over their bounds, a base that some ranges lack."""
    rng = random.Random(7)
    base = [rng.choice([5.0, rng.uniform(0, 9)]) for _ in range(500)]
    windows = {1: [5.0] * 300 + [7.5], 2: [rng.uniform(-20, 20) for _ in range(300)], 3: [50.0, 60.0, 70.0]}
    cur = None
    for w, values in windows.items():
        part = _counts(spark, values, k="x", w=w)
        cur = part if cur is None else cur.unionByName(part)
    want = {w: round(_brute_ks(v, base), 12) for w, v in windows.items()}
    moved = []
    monkeypatch.setattr(D, "CHUNK_ROWS", 40)
    monkeypatch.setattr(D, "materialize", lambda df, name="cut": moved.append(name) or materialize(df, name))
    got = D.ks_statistics(cur, _counts(spark, base, k="x"), ["k"], ["k", "w"]).collect()
    assert {r.w: round(r.ks_statistic, 12) for r in got} == want
    assert "chunks" not in moved  # values are moved once


def test_cells_are_counted_before_they_are_copied(spark):
    """Counts by cell are those by group; a row is no longer copied to each slice first."""
    rows = [(i % 3, None if i % 5 == 0 else f"t{i % 4}", float(i % 7), f"2024-01-0{1 + i % 3} 00:00:00") for i in range(200)]
    df = spark.createDataFrame(rows, "a int, t string, x double, at string").withColumn("at", F.col("at").cast("timestamp"))
    spec = MonitorSpec(TimeSeries("at"), ("1 day", "1 month"), slicing_exprs=("t", "a > 1"), exact=True)
    cells = P.cell_rows(df, spec)
    assert cells.count() == 200 and {len(r[0]) for r in cells.select("_gids").collect()} == {6}
    by = [*P.GROUP, "column_name", "num", "txt"]
    want = value_counts(P.group_rows(df, spec), P.GROUP, ["a", "t", "x"])
    got = P.group_value_counts(df, spec)
    assert want.select(*by, "n").exceptAll(got.select(*by, "n")).count() == 0 and got.count() == want.count()
    daily = spec.with_params(granularities=("1 day",))
    days = P.group_list(df, daily).select("granularity", "window").distinct().limit(2)
    some = P.group_value_counts(df, daily, only_windows=materialize(days))
    assert some.select("window").distinct().count() == 2
    assert some.exceptAll(P.group_value_counts(df, daily)).count() == 0


def _odd_log(spark):
    """Values with NULLs, a column far from zero, an empty one, texts; a slice value per few rows."""
    return spark.range(4000).selectExpr(
        "timestamp_seconds(CAST(-5000000 + (id * 7919) % 20000000 AS LONG)) AS ts",
        "if(id % 11 = 0, NULL, 1700000000000 + id % 37) AS x", "CAST((id * 31) % 101 AS DOUBLE) / 7 - 3 AS v",
        "CAST(NULL AS INT) AS none", "if(id % 5 = 0, NULL, repeat('é', CAST(id % 4 AS INT))) AS t", "id % 3 = 0 AS flag",
        "if(id % 13 = 0, NULL, CAST(id % 4 AS STRING)) AS s", "if(id % 97 = 0, -0.0D, CAST(id % 2 AS DOUBLE)) AS zero",
    )


@pytest.mark.parametrize("log_type", ["INPUT", "BASELINE"])
def test_metrics_merged_from_cells(spark, monkeypatch, log_type):
    df = _odd_log(spark)
    spec = MonitorSpec(TimeSeries("ts"), ("1 week", "3 months"), ("s", "v > 0"), exact=False)
    only = None
    if log_type == "INPUT":
        only = materialize(P.group_list(df, spec).select("granularity", "window").distinct().where("month(window.start) < 4"))
    found = {}
    for cells in (True, False):
        if not cells:
            monkeypatch.setattr(P, "by_cells", lambda *_: False)
        rows = P.profile(df, spec, log_type, only_windows=only).collect()
        found[cells] = {tuple(r[k] for k in (*P.GROUP, "column_name")): r.asDict() for r in rows}
        assert len(rows) == len(found[cells])
    assert found[True].keys() == found[False].keys() and len(found[True]) > 50
    for key, want in found[False].items():
        got = found[True][key]
        assert got.keys() == want.keys()
        n = want["count"] - (want["num_nulls"] or 0)
        for name in want.keys() - {"sketch", "median", "distinct_count", "percent_distinct"}:
            # At 1.7e12 the mean of a cell is known to 2e-4, of values that differ by ten.
            near = {"rel": 1e-5 if name == "stddev" else 1e-9, "abs": 1e-9}
            assert got[name] == (pytest.approx(want[name], **near) if isinstance(want[name], float) else want[name]), (key, name)
        for name, off in (("distinct_count", 0.1 * (want["distinct_count"] or 0) + 1), ("percent_distinct", 0.1 + 1 / max(1, n))):
            assert (got[name] is None) == (want[name] is None) and (got[name] is None or abs(got[name] - want[name]) <= off), (key, name)
        assert (got["median"] is None) == (want["median"] is None) and (got["sketch"] is None) == (want["sketch"] is None)
        # The sketches keep every value of groups this small.
        assert n > 800 or got["median"] == want["median"], key


def test_sketches_see_a_row_once(spark):
    """Sketches are made below the generator that copies what is left of a row's cell to its groups."""
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    spec = MonitorSpec(TimeSeries("l_shipdate"), ("1 year",), ("l_returnflag",), columns=("l_tax", "l_linestatus"), exact=False)
    plan = P.profile(df, spec)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    copied = max(i for i, line in enumerate(lines) if "Generate explode" in line)
    assert [i > copied for i, line in enumerate(lines) if "kll_sketch_agg_double" in line] == [True]


def test_cells_of_many_slices_are_not_summed_up(spark):
    """Slices of 60 values each, all crossed: 3,600 cells stand for 120 groups."""
    df = spark.range(3600).selectExpr("timestamp'2024-01-01' AS ts", "id % 60 AS a", "id DIV 60 AS b", "id AS v")
    spec = MonitorSpec(TimeSeries("ts"), ("1 day",), ("a", "b"), columns=("v",), exact=False)
    types = [df.schema["v"].dataType]
    assert not P.by_cells(P._placed(df, spec, "INPUT", None, numbered=True), spec, types)
    same = spec.with_params(slicing_exprs=("a", "a + 1"))
    assert P.by_cells(P._placed(df, same, "INPUT", None, numbered=True), same, types)
    counts = {(r.slice_key, r.slice_value): r["count"] for r in P.profile(df, spec).where("column_name = 'v'").collect()}
    assert len(counts) == 121 and counts[(None, None)] == 3600 and counts[("a", "7")] == 60


def test_marks_are_exact_sums_read_once(spark, tmp_path):
    from tidemark.functions.columns import row_hash
    from tidemark.operators.windows import window_of

    _odd_log(spark).write.parquet(f"{tmp_path}/log")
    df = spark.read.parquet(f"{tmp_path}/log")
    spec = MonitorSpec(TimeSeries("ts"), ("1 day", "1 month"))
    want = {}
    for r in df.select(*[window_of(F.col("ts"), g).alias(g) for g in spec.granularities], row_hash(df).alias("h")).collect():
        for g in spec.granularities:
            n, total = want.get((g, r[g]), (0, 0))
            want[(g, r[g])] = n + 1, total + r.h
    marks = R.window_marks(df, spec)
    assert {(r.granularity, r.window): (r.rows, int(r.mark)) for r in marks.collect()} == want
    assert dict(marks.dtypes)["mark"] == "decimal(38,0)"
    moved = R.moved_windows(marks, R.window_marks(df.where("v != 0"), spec))
    assert moved._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    gone = df.where("NOT (v != 0)").select(F.explode(F.array(*[F.struct(F.lit(g).alias("g"), window_of(F.col("ts"), g).alias("w")) for g in spec.granularities])).alias("c"))
    assert {(r[0], r[1]) for r in moved.collect()} == {(r.c.g, r.c.w) for r in gone.collect()}


def test_windows_around_the_epoch(spark):
    from tidemark.operators.windows import window_of

    times = [dt.datetime(1969, 11, 30, 23, 59, 59), dt.datetime(1970, 1, 1), dt.datetime(1899, 12, 31, 1), dt.datetime(2024, 2, 29, 12)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    want = {
        "3 months": [(1969, 10, 1), (1970, 1, 1), (1899, 10, 1), (2024, 1, 1)], "1 year": [(1969, 1, 1), (1970, 1, 1), (1899, 1, 1), (2024, 1, 1)],
        "1 week": [(1969, 11, 24), (1969, 12, 29), (1899, 12, 25), (2024, 2, 26)], "1 day": [(1969, 11, 30), (1970, 1, 1), (1899, 12, 31), (2024, 2, 29)],
    }
    for g, starts in want.items():
        got = df.select(window_of(F.col("ts"), g)["start"].cast("string").alias("s")).collect()
        assert [r.s for r in got] == [f"{y}-{m:02d}-{d:02d} 00:00:00" for y, m, d in starts], g


@pytest.mark.parametrize("name", ["sketched_refresh", "refresh_with_new_column"])
def test_table_is_dealt_out_once(spark, monkeypatch, name):
    from tidemark.queries import refresh_queries as Q

    calls, read = [], Q.lineitem
    monkeypatch.setattr(Q, "lineitem", lambda *a: calls.append(a) or read(*a))
    assert getattr(Q, name)(spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1
