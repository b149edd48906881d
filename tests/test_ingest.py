"""Payloads, upserts, tables, column kinds and the lifecycle of monitors."""

import datetime as dt
import json
import math

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import InferenceLog, Metric, MonitorSpec, TimeSeries
from tidemark.functions import dates
from tidemark.functions.templates import render
from tidemark.operators import joins as J
from tidemark.operators import kinds as N
from tidemark.operators import payloads as K
from tidemark.operators import usage as U
from tidemark.plans import monitors as M
from tidemark.session import scratch_path
from tidemark.sources import tables as A
from tidemark.sources.tables import among, upsert_partitions
from tidemark.streaming import ingest as L

FIELDS = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b c", T.StringType())])


@pytest.mark.parametrize(
    "payload, records",
    [
        ('{"dataframe_records": [{"a": 1, "b c": "x"}]}', [{"a": 1, "b c": "x"}]),
        ('{"columns": ["a", "b c"], "data": [[1, "x"], [2, null]]}', [{"a": 1, "b c": "x"}, {"a": 2, "b c": None}]),
        ('{"columns": ["a", "b c"], "data": [[1]]}', [{"a": 1}]),
        ('{"instances": [{"a": [1, {"z": "}"}]}]}', [{"a": [1, {"z": "}"}]}]),
        ('{"inputs": {"a": [1, 2, 3], "b c": ["x", "y"]}}', [{"a": 1, "b c": "x"}, {"a": 2, "b c": "y"}]),
        ('{"inputs": {"a": []}}', []),
        ('{"predictions": [0.5, "n", [1]]}', [{"predictions": 0.5}, {"predictions": "n"}, {"predictions": [1]}]),
        ('{"dataframe_records": [], "instances": [{"a": 1}]}', []),
        ('{"columns": ["a"], "predictions": [1]}', [{"predictions": 1}]),
        ('{"quote\\"d": 1}', []),
        ('{"columns": ["q\\"x"], "data": [[1]]}', [{'q"x': 1}]),
    ],
)
def test_payload_shapes(spark, payload, records):
    df = spark.createDataFrame([(payload,)], "p string")
    assert json.loads(df.select(K.record_array(F.col("p"))).first()[0]) == records


@pytest.mark.parametrize("payload", ["garbage {", "[1, 2]", "5", '"text"', "", "{"])
def test_other_payloads_pass_through(spark, payload):
    df = spark.createDataFrame([(payload,)], "p string")
    assert df.select(K.record_array(F.col("p"))).first()[0] == payload


def test_null_payload(spark):
    df = spark.createDataFrame([(None,)], "p string")
    assert df.select(K.record_array(F.col("p"))).first()[0] is None


def test_shorter_side_is_padded_and_ids_repeat(spark):
    raw = spark.createDataFrame(
        [("r1", '{"instances":[{"a":1,"b c":"x"},{"a":2}]}', '{"predictions":[7]}', 1500), ("r2", "broken", "broken", 0)],
        "log_id string, request string, response string, timestamp_ms long",
    )
    field = T.StructField("predictions", T.DoubleType())
    rows = K.process_requests(raw, FIELDS, field, ["log_id"]).orderBy("a").collect()
    assert [(r.a, r["b c"], r.predictions) for r in rows] == [(1.0, "x", 7.0), (2.0, None, None)]
    assert rows[0].timestamp == dt.datetime(1970, 1, 1, 0, 0, 1, 500000)
    again = K.process_requests(raw, FIELDS, field, ["log_id"]).orderBy("a").collect()
    assert [r.example_id for r in rows] == [r.example_id for r in again]
    assert rows[0].example_id != rows[1].example_id


def test_payloads_need_no_python(spark):
    df = spark.createDataFrame([("{}",)], "p string")
    assert "Python" not in df.select(K.record_array(F.col("p")))._jdf.queryExecution().executedPlan().toString()


def test_upsert_rules(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    source = spark.createDataFrame([(2, "B", 1), (3, "C", 1), (None, "N", 1)], "k int, v string, extra int")
    out = J.upsert(target, source, ["k"])
    got = sorted((str(r.k), r.v, r.extra) for r in out.collect())
    assert got == [("1", "a", None), ("2", "B", 1), ("3", "C", 1), ("None", "N", 1), ("None", "n", None)]
    no_null = source.where("k IS NOT NULL")
    once = J.upsert(target, no_null, ["k"])
    assert J.upsert(once, no_null, ["k"]).exceptAll(once).isEmpty()
    twice = spark.createDataFrame([(2, "x"), (2, "y")], "k int, v string")
    with pytest.raises(ValueError):
        J.upsert(target, twice, ["k"])
    # Two new rows with one key match nothing and are both added.
    assert J.upsert(target, spark.createDataFrame([(9, "x"), (9, "y")], "k int, v string"), ["k"]).count() == 5


def test_partitioned_upsert_leaves_other_partitions_alone(spark):
    path = scratch_path(spark, "t")
    A.upsert_partitions(spark, path, spark.createDataFrame([("d1", 1, "a"), ("d2", 1, "b")], "date string, k int, v string"), ["date", "k"], "date")
    A.upsert_partitions(spark, path, spark.createDataFrame([("d2", 1, "B"), ("d3", 1, "c")], "date string, k int, v string"), ["date", "k"], "date")
    got = {(r.date, r.v) for r in spark.read.parquet(path).collect()}
    assert got == {("d1", "a"), ("d2", "B"), ("d3", "c")}


def test_delete_keeps_null_predicates(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "a int")
    assert sorted(str(r.a) for r in J.delete_where(df, "a > 3").collect()) == ["1", "None"]


def test_full_join_keeps_the_fan_out(spark):
    key = "date date, provider string, customer_type string, customer string, workspace_id long"
    day = dt.date(2024, 1, 6)
    p = spark.createDataFrame([(day, "a", "t", "c1", 1, 2, 1.0), (day, "a", "t", "c2", 1, 3, 2.0)], key + ", num_calls long, revenue double")
    c = spark.createDataFrame([(day, "a", "t", "c1", 1, 10.0)], key + ", revenue double")
    rows = U.combine_revenue(p, c).collect()
    assert sorted(r.revenue for r in rows) == [11.0, 12.0]
    assert rows[0].week_start == day


def test_price_of_unknown_provider_is_discounted(spark):
    df = spark.createDataFrame([(None, 10.0, None), (None, 10.0, "aws"), (None, 10.0, "azure"), (3.0, 10.0, None)], "rate double, l double, p string")
    got = [r[0] for r in df.select(U.effective_price(F.col("rate"), F.col("l"), F.col("p"), "azure")).collect()]
    assert got == [8.5, 10.0, 8.5, 3.0]


def test_week_starts_on_saturday(spark):
    got = spark.sql("SELECT date'2022-03-22' AS d UNION ALL SELECT date'2022-03-19' UNION ALL SELECT date'2022-03-18'").select(dates.saturday_week_start(F.col("d")))
    assert [str(r[0]) for r in got.collect()] == ["2022-03-19", "2022-03-19", "2022-03-12"]


def test_template_slots():
    assert render("avg({{ column_name }})", column_name="x") == "avg(x)"
    with pytest.raises(ValueError):
        render("{{other}}", column_name="x")


def test_snapshot_tables_survive_a_failed_write(spark):
    path = scratch_path(spark, "snap")
    t = A.SnapshotTable(spark, path)
    with pytest.raises(FileNotFoundError):
        t.read()
    t.replace(spark.range(3))
    t.replace(t.read().where("id > 0"))
    spark.range(9).write.parquet(f"{path}/v=00000003")
    A.remove(spark, f"{path}/v=00000003/_SUCCESS")
    assert t.read().count() == 2
    t.merge_schema(spark.range(1).withColumn("new", F.lit(1)))
    assert t.read().columns == ["id", "new"] and t.read().count() == 3


def test_text_kinds(spark):
    prof = spark.createDataFrame(
        [("id", 300, ["1", "2"]), ("price", 50, ["1.5", "2"]), ("code", 50, ["1", "2"]), ("flag", 5, ["0", "1"]), ("grade", 20, ["1", "2"]), ("name", 900, ["a", "1"])],
        "column_name string, num_of_dist_val long, samples array<string>",
    )
    got = {r.column_name: r.kind for r in N.numeric_strength(prof).collect()}
    assert got == {
        "id": "strong_numeric", "price": "strong_numeric", "code": "weak_numeric", "flag": "strong_categorical",
        "grade": "weak_categorical", "name": "strong_categorical",
    }


def test_datetime_rules(spark):
    rows = [("2020-01-01", "2020-01-01", None, "2020", "x"), ("2020-01-02", "bad", None, "2021", "y"), ("2020-01-03 10:00:00", "bad", None, "2022", None)]
    df = spark.createDataFrame(rows, "good string, one_bad string, empty string, year string, words string")
    got = {r.column_name: r.is_datetime for r in N.datetime_columns(df).collect()}
    assert got == {"good": True, "one_bad": True, "empty": False, "year": False, "words": False}


def test_specs_round_trip():
    spec = MonitorSpec(
        InferenceLog("ts", "p", "v", "regression", label_col="y"), ("1 day",), ("a > 2",),
        (Metric("aggregate", "m", ("x",), "avg(`{{column_name}}`)"),), columns=("x",),
    )
    assert M.spec_from_json(M.spec_to_json(spec)) == spec


def test_monitor_errors(spark):
    monitors = M.Monitors(spark, scratch_path(spark, "m"))
    for call in (monitors.info, monitors.delete, monitors.refresh):
        with pytest.raises(M.MonitorError) as error:
            call("nothing")
        assert error.value.code == "MONITOR_NOT_FOUND"
    spark.range(3).createOrReplaceTempView("tiny")
    with pytest.raises(M.MonitorError):
        monitors.create_or_update("tiny", MonitorSpec(TimeSeries("ts"), ("1 day",)))


def test_logging_table_checks_its_schema(spark):
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("y", T.IntegerType())])
    log = M.LoggingTable(spark, scratch_path(spark, "log"), schema, ["id"])
    with pytest.raises(ValueError):
        log.log_scored(spark.range(2).withColumnRenamed("id", "other"), "1", "a")
    log.log_scored(spark.range(4), "1", "a")
    log.log_scored(spark.range(4, 8), "1", "b")
    labels = spark.createDataFrame([(1, 5), (6, 7), (99, 1)], "id long, y int")
    assert log.log_labels(labels, "y") == 2
    assert {r.id: r.y for r in log.read().where("y IS NOT NULL").collect()} == {1: 5, 6: 7}
    log.remove_batch("INPUT", "1", "a")
    assert log.read().count() == 4


def test_no_log_folder_is_an_error(spark):
    with pytest.raises(FileNotFoundError):
        L.read_request_stream(spark, [scratch_path(spark, "none")])


def test_upsert_reads_only_the_partitions_of_the_source(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "cast(id % 10 AS string) AS day").write.partitionBy("day").parquet(path)
    rows = spark.read.schema("id long, day string").parquet(path).where(among(["day"], [("3",), ("4",)]))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "3" in filters and "4" in filters
    source = spark.createDataFrame([(3, "3"), (1003, "3")], "id long, day string")
    upsert_partitions(spark, path, source, ["id", "day"], "day")
    assert spark.read.schema("id long, day string").parquet(path).count() == 101


def test_labels_given_twice_and_to_baseline_rows(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("y", T.IntegerType())])
    log = M.LoggingTable(spark, str(tmp_path / "log"), schema, ["id"])
    log.log_baseline(spark.range(4).select("id"), "v:1", "a")
    log.log_baseline(spark.range(4).select("id"), "v:1", "b")
    log.log_scored(spark.range(2).select("id"), "v:1", "c")
    labels = spark.createDataFrame([(1, 5), (1, 5), (0, None), (9, 1)], "id long, y int")
    assert log.log_labels(labels, "y") == 1 and log.log_labels(labels, "y") == 0
    got = sorted((r.log_type, r.id, r.y) for r in log.read().collect())
    assert got == [("BASELINE", i, None) for i in range(4)] + [("INPUT", 0, None), ("INPUT", 1, 5)]
    with pytest.raises(ValueError):
        log.log_labels(spark.createDataFrame([(1, 5), (1, 6)], "id long, y int"), "y")


def test_metrics_of_a_stream_are_compacted(spark, tmp_path):
    data, path, checkpoint = (str(tmp_path / n) for n in ("data", "metrics", "checkpoint"))
    spec = MonitorSpec(TimeSeries("ts"), ("1 day",), columns=("v",))
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).selectExpr("timestamp'2024-01-01' AS ts", "id AS v").write.mode("append").parquet(data)
        L.update_metrics_stream(spark.readStream.schema("ts timestamp, v long").parquet(data), spec, path, checkpoint)
        assert not (tmp_path / "metrics" / "batches" / f"batch={i}").exists()
    row = L.merged_metrics(spark, path).where("column_name = 'v'").first()
    assert (row["count"], row["avg"], row["max"]) == (30, 14.5, 29.0)


def brute_pairs(text):
    """Numbers of the symbol pairs, sign by sign."""
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    flat = " " + re.sub("[^a-z~]+", " ", re.sub(r"[^\x00-\x7F]+", "~", low)).strip(" ") + " "
    codes = [N.SYMBOLS.index(c) for c in flat]
    return [a * len(N.SYMBOLS) + b for a, b in zip(codes, codes[1:])]


def test_symbol_pairs(spark):
    texts = ["The CAT, 42!", "", "  ", "é", "日本 😀x", "a\nb\x00c", "ÉTÉ ~ t", "word " * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["p"] for r in df.select(N.symbol_pairs(F.col("t")).alias("p")).collect()]
    assert got == [brute_pairs(t) for t in texts]


def test_fitted_language(spark):
    """The model is counts plus one; it tells languages apart in texts it has not seen."""
    rows = [("en", "the cat and the dog", 0), ("de", "die katze und der hund", 0), (None, "zzz", 0), ("en", None, 0)]
    df = spark.createDataFrame(rows, "lang string, t string, x int")
    model = N.fit_language(df, "t", F.col("lang") == "en")
    of = {"en": brute_pairs(rows[0][1]), "de": brute_pairs(rows[1][1])}
    size = len(N.SYMBOLS) ** 2
    for pair in range(size):
        share = [math.log((of[k].count(pair) + 1) / (len(of[k]) + size)) for k in ("en", "de")]
        assert abs(model.ratios[pair] - (share[0] - share[1])) < 1e-12
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang IS NOT NULL")
    learned = N.fit_language(docs.where("doc_id % 2 = 0"), "text", F.col("lang") == "en")
    e = learned.evidence(F.col("text"))
    rest = docs.where("doc_id % 2 = 1").select("lang", N.confidence(e["total"], e["pairs"]).alias("p")).collect()
    right = sum((r["p"] > 0.5) == (r["lang"] == "en") for r in rest)
    assert right >= 0.97 * len(rest)
    none = spark.createDataFrame([("",)], "text string").select(e.alias("e")).select(N.confidence(F.col("e.total"), F.col("e.pairs"))).first()[0]
    assert 0 <= none <= 1
