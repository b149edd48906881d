"""Refresh by files: what is listed, what is read, what is recomputed."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.plans import files as C
from tidemark.plans import refresh as R
from tidemark.plans.monitors import Monitors
from tidemark.session import scratch_name, scratch_path
from tidemark.sources.tables import save_table
from tidemark.spec import MonitorSpec, TimeSeries

SPEC = MonitorSpec(TimeSeries("ts"), ("1 day",), columns=("x",))
START = dt.datetime(2024, 1, 1)


def files_read(df):
    """Files that the scans of an executed plan opened."""
    df.collect()

    def walk(node):
        metrics, found = node.metrics(), 0
        if metrics.contains("numFiles"):
            found += metrics.apply("numFiles").value()
        if node.nodeName() == "AdaptiveSparkPlan":
            return found + walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return found + walk(node.plan())
        children = node.children()
        return found + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def days(spark, *numbers, rows=5):
    data = [(START + dt.timedelta(days=d, hours=h), float(d + h)) for d in numbers for h in range(rows)]
    return spark.createDataFrame(data, "ts timestamp, x double").coalesce(1)


@pytest.fixture
def name(spark):
    table = scratch_name("days")
    save_table(days(spark, 0, 1), table, path=scratch_path(spark, "days"))
    save_table(days(spark, 2), table, mode="append")
    save_table(days(spark, 3), table, mode="append")
    yield table
    spark.sql(f"DROP TABLE {table}")


def starts(windows):
    return sorted(r["window"]["start"].day - 1 for r in windows.collect())


def test_one_added_file_is_the_only_one_read(spark, name):
    before = C.file_changes(spark.table(name), SPEC, None)
    assert starts(before.touched) == [0, 1, 2, 3]
    save_table(days(spark, 3, rows=2), name, mode="append")
    df = spark.table(name)
    old = [r["path"] for r in before.files.select("path").distinct().collect()]
    new = C.join_null_safe(C.listing(df), before.files, C.FILE, "left_anti")
    paths = [r["path"] for r in new.collect()]
    assert len(old) == 3 and len(paths) == 1
    # Its own listing and its times.
    assert files_read(C.only_files(df, paths).select("ts")) == 1
    after = C.file_changes(df, SPEC, before.files)
    assert starts(after.touched) == [3]
    # Of the rows, those of the two files that hold the touched day.
    assert files_read(C.rows_of_windows(df, after.files, after.touched)) == 2
    again = C.file_changes(df, SPEC, after.files)
    assert again.touched.count() == 0 and again.files.count() == after.files.count()


def test_gone_and_rewritten_files(spark, name):
    before = C.file_changes(spark.table(name), SPEC, None)
    victim = [r["path"] for r in before.files.collect() if r["window"]["start"].day == 3][0]
    path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(victim))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    spark.catalog.refreshTable(name)
    after = C.file_changes(spark.table(name), SPEC, before.files)
    assert starts(after.touched) == [2]
    assert after.files.select("path").distinct().count() == 2


def test_other_granularities_read_all(spark, name):
    before = C.file_changes(spark.table(name), SPEC, None)
    hourly = SPEC.with_params(granularities=("1 hour",))
    after = C.file_changes(spark.table(name), hourly, before.files)
    got = {r["granularity"] for r in after.touched.collect()}
    assert got == {"1 day", "1 hour"} and {r["granularity"] for r in after.files.collect()} == {"1 hour"}


def test_rows_without_time_and_empty_tables(spark):
    table = scratch_name("days")
    save_table(days(spark).withColumn("ts", F.lit(None).cast("timestamp")), table, path=scratch_path(spark, "days"))
    save_table(spark.createDataFrame([(None, 1.0)], "ts timestamp, x double"), table, mode="append")
    found = C.file_changes(spark.table(table), SPEC, None)
    assert found.touched.count() == 0 and found.files.where("window IS NULL").count() >= 1
    assert C.file_changes(spark.table(table), SPEC, found.files).touched.count() == 0
    spark.sql(f"DROP TABLE {table}")


def test_monitor_follows_files(spark, name):
    monitors = Monitors(spark, scratch_path(spark, "monitors"))
    monitors.create_or_update(name, SPEC)

    def counts():
        rows = monitors.analysis(name).where("column_name = 'x'").collect()
        return {r["window"]["start"].day - 1: r["count"] for r in rows}

    assert counts() == {0: 5, 1: 5, 2: 5, 3: 5}
    save_table(days(spark, 3, 7, rows=2), name, mode="append")
    monitors.refresh(name)
    assert counts() == {0: 5, 1: 5, 2: 5, 3: 7, 7: 2}
    assert monitors.drift(name).where("column_name = 'x'").count() == 4
    save_table(days(spark, 1, rows=3), name, mode="overwrite")
    monitors.refresh(name)
    assert counts() == {1: 3}
    monitors.refresh(name)
    assert counts() == {1: 3}


def test_a_refresh_that_fails_between_its_tables(spark, name, monkeypatch):
    """Readers see analysis and drift of one version, and the next refresh catches up."""
    monitors = Monitors(spark, scratch_path(spark, "monitors"))
    info = monitors.create_or_update(name, SPEC)
    save_table(days(spark, 9), name, mode="append")
    calls = []
    from tidemark.sources import tables

    original = tables.SnapshotTable.replace

    def failing(self, df, version=None):
        if self.path == info.analysis_metrics_path:
            calls.append(version)
            raise RuntimeError("no space")
        return original(self, df, version)

    monkeypatch.setattr(tables.SnapshotTable, "replace", failing)
    with pytest.raises(RuntimeError):
        monitors.refresh(name)
    monkeypatch.setattr(tables.SnapshotTable, "replace", original)
    assert calls == [2]
    last = F.max("window.start")
    assert monitors.drift(name).agg(last).first() == monitors.analysis(name).agg(last).first()
    monitors.refresh(name)
    assert monitors.analysis(name).agg(last).first()[0].day == 10
    assert monitors.drift(name).agg(last).first()[0].day == 10


def test_marks_tell_moves_and_names(spark):
    rows = [(START, 1, None)], [(START, None, 1)]
    a, b = (spark.createDataFrame(r, "ts timestamp, a int, b int") for r in rows)
    spec = MonitorSpec(TimeSeries("ts"), ("1 day",))
    assert R.moved_windows(R.window_marks(a, spec), R.window_marks(b, spec)).count() == 1
    assert R.moved_windows(R.window_marks(a, spec), R.window_marks(a.withColumnRenamed("a", "c"), spec)).count() == 1
    added = a.withColumn("d", F.lit(None).cast("string"))
    assert R.moved_windows(R.window_marks(a, spec), R.window_marks(added, spec)).count() == 0
    only = spec.with_params(columns=("a",))
    other = spark.createDataFrame([(START, 1, 5)], "ts timestamp, a int, b int")
    assert R.moved_windows(R.window_marks(a, only), R.window_marks(other, only)).count() == 0
