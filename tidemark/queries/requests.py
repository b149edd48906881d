"""Request-log payloads and streams, built from the events table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.dates import within_days
from tidemark.operators import joins as J
from tidemark.operators import payloads as K
from tidemark.queries.monitoring import R, flat, rounded, stamp
from tidemark.queries.registry import ROWS_A_TASK, query, table, tasks_of
from tidemark.session import scratch_path
from tidemark.spec import MonitorSpec, TimeSeries
from tidemark.streaming import ingest as L

FIELDS = T.StructType(
    [
        T.StructField("value", T.DoubleType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("user_id", T.LongType()),
    ]
)
PREDICTION = T.StructField("predictions", T.DoubleType())
AS_OF = dt.date(2024, 1, 31)


def request_log(spark, sf) -> DataFrame:
    """Raw log rows: one of five payload shapes each, every 97th broken.

    The columnar shapes hold two records of which the response answers one.
    """
    v, e, u = (F.to_json(F.struct(c)) for c in ("value", "event_type", "user_id"))

    def bare(c, name):  # the value inside {"name":value}
        return F.substring(c, F.lit(len(name) + 5), F.length(c) - (len(name) + 5))

    v, e, u = bare(v, "value"), bare(e, "event_type"), bare(u, "user_id")
    record = F.concat(
        F.lit('{"value":'), v, F.lit(',"event_type":'), e, F.lit(',"user_id":'), u, F.lit("}")
    )
    shapes = [
        F.concat(F.lit('{"dataframe_records":['), record, F.lit("]}")),
        F.concat(
            F.lit('{"columns":["value","event_type","user_id"],"data":[['), v, F.lit(","), e, F.lit(","), u, F.lit("]]}")
        ),
        F.concat(F.lit('{"instances":['), record, F.lit(","), record, F.lit("]}")),
        F.concat(
            F.lit('{"inputs":{"value":['), v, F.lit(","), v, F.lit('],"event_type":['), e, F.lit(","), e,
            F.lit('],"user_id":['), u, F.lit(","), u, F.lit(",0]}}"),
        ),
        F.concat(F.lit('{"other":['), record, F.lit("]}")),
    ]
    which = F.col("event_id") % 5
    request = F.when(F.col("event_id") % 97 == 0, F.lit('{"instances": [')).otherwise(
        F.coalesce(*[F.when(which == i, s) for i, s in enumerate(shapes)])
    )
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("log_id"),
        request.alias("request"),
        F.concat(F.lit('{"predictions":['), (F.col("value") * 2).cast("string"), F.lit("]}")).alias("response"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        F.to_date("ts").alias("date"),
        (F.col("event_id") % 2 + 1).cast("string").alias("model_version"),
    )


# SQL: how many records a log row holds, and its records after pairing.
_LOG = """log_ AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN -1 ELSE event_id % 5 END AS shape FROM events)"""
_RECORDS = f"""{_LOG},
rec AS (SELECT event_id, ts, p AS position,
    CASE WHEN shape IN (0, 1) AND p = 0 OR shape IN (2, 3) THEN value END AS value,
    CASE WHEN shape IN (0, 1) AND p = 0 OR shape IN (2, 3) THEN event_type END AS event_type,
    CASE WHEN shape IN (0, 1) AND p = 0 OR shape IN (2, 3) THEN user_id END AS user_id,
    CASE WHEN p = 0 THEN value * 2 END AS predictions
    FROM log_, (SELECT unnest([0, 1]) AS p)
    WHERE shape IN (2, 3) OR shape IN (0, 1, 4) AND p = 0)"""


@query(
    "k1_record_array",
    f"""WITH {_LOG} SELECT event_id::VARCHAR AS log_id, CASE WHEN shape IN (0, 1) THEN 1 WHEN shape IN (2, 3) THEN 2
        WHEN shape = 4 THEN 0 END AS n_records, shape = -1 AS unchanged,
        CASE WHEN shape IN (0, 1, 2, 3) THEN user_id::VARCHAR END AS last_user FROM log_""",
)
def record_array(spark, sf):
    records = K.record_array(F.col("request"))
    rows = request_log(spark, sf).select("log_id", "request", records.alias("r"))
    parsed = F.from_json("r", "array<map<string,string>>")
    return rows.select(
        "log_id",
        F.json_array_length("r").alias("n_records"),
        (F.col("r") == F.col("request")).alias("unchanged"),
        F.try_element_at(F.try_element_at(parsed, F.lit(-1)), F.lit("user_id")).alias("last_user"),
    )


@query(
    "k1_odd_objects",
    "SELECT event_id, 2 AS n_records, event_id::VARCHAR AS last_user FROM events",
)
def odd_objects(spark, sf):
    """Objects after line breaks and tabs, with repeated keys: the last value counts."""
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    payload = F.concat(
        F.lit('\n\t{"a": 1, "a": 2, "instances": [{"user_id": "'), user,
        F.lit('"}, {"user_id": "x", "user_id": "'), event, F.lit('"}]}'),
    )
    parsed = F.from_json(K.record_array(payload), "array<map<string,string>>")
    return table(spark, sf, "events").select(
        "event_id",
        F.size(parsed).alias("n_records"),
        F.try_element_at(F.try_element_at(parsed, F.lit(-1)), F.lit("user_id")).alias("last_user"),
    )


@query(
    "k2_typed_records",
    f"""WITH {_LOG} SELECT shape >= 0 AS readable, CASE WHEN shape IN (0, 1) THEN 1 WHEN shape IN (2, 3) THEN 2 WHEN shape = 4 THEN 0 END AS n_records,
        count(*) AS n, {R('sum(CASE WHEN shape IN (0, 1, 2, 3) THEN value END)', 4)} AS total FROM log_ GROUP BY ALL""",
)
def typed_records(spark, sf):
    rows = request_log(spark, sf).select(K.typed_records(F.col("request"), FIELDS).alias("r"))
    first = F.try_element_at("r", F.lit(1))["value"]
    return rows.groupBy(
        F.col("r").isNotNull().alias("readable"),
        F.when(F.col("r").isNotNull(), F.size("r")).alias("n_records"),
    ).agg(F.count("*").alias("n"), rounded(F.sum(first), 4).alias("total"))


@query(
    "k3_paired_records",
    f"""WITH {_RECORDS} SELECT event_id::VARCHAR AS log_id, position AS "_position", value, event_type, user_id, predictions FROM rec""",
)
def paired_records(spark, sf):
    rows = request_log(spark, sf).select(
        "log_id",
        K.typed_records(F.col("request"), FIELDS).alias("request"),
        K.typed_records(F.col("response"), T.StructType([PREDICTION])).alias("response"),
    )
    return K.explode_batches(rows)


_PROCESSED = f"""WITH {_RECORDS}
    SELECT event_id::VARCHAR AS log_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS timestamp,
        md5(concat(event_id, '-', position)) AS example_id, value, event_type, user_id, predictions FROM rec"""
_OUT = ("log_id", "example_id", "value", "event_type", "user_id", "predictions")


@query("k4_process_requests", _PROCESSED)
def process_requests(spark, sf):
    rows = K.process_requests(request_log(spark, sf), FIELDS, PREDICTION, ["log_id"])
    return rows.select(*_OUT, stamp(F.col("timestamp")).alias("timestamp"))


#: Bytes of a block of a log file, which one task reads: a file is as many tasks as blocks.
LOG_BLOCK = 1 << 20


def _write_log(rows: DataFrame, files: int, path: str) -> None:
    """Log rows as so many more files of a folder."""
    out = rows.repartition(files, "log_id").write.mode("append").option("parquet.block.size", LOG_BLOCK)
    out.parquet(path)


def _log_files(spark, sf) -> int:
    return tasks_of(table(spark, sf, "events"), 3, 4 * ROWS_A_TASK)


def _staged_log(spark, sf) -> tuple[str, str]:
    """The log written to two folders by model version, several files each."""
    paths = tuple(scratch_path(spark, f"requests-{v}") for v in (1, 2))
    log, files = request_log(spark, sf), _log_files(spark, sf)
    for v, path in zip(("1", "2"), paths):
        _write_log(log.where(F.col("model_version") == v), files, path)
    return paths


def _config(spark, sf, paths=None, **other) -> L.InferenceConfig:
    return L.InferenceConfig(
        log_paths=paths or _staged_log(spark, sf),
        processed_path=scratch_path(spark, "processed"),
        joined_path=scratch_path(spark, "joined"),
        checkpoint_path=scratch_path(spark, "stream"),
        request_fields=FIELDS,
        response_field=PREDICTION,
        max_files=2,
        **other,
    )


@query(
    "l1_union_of_streams",
    "SELECT (event_id % 2 + 1)::VARCHAR AS model_version, count(*) AS n FROM events GROUP BY ALL",
)
def union_of_streams(spark, sf):
    """Two logging folders that exist and one that does not, read as one stream."""
    out = scratch_path(spark, "raw")
    paths = [*_staged_log(spark, sf), scratch_path(spark, "missing")]
    L.append_available(L.read_request_stream(spark, paths), out, scratch_path(spark, "stream"))
    return spark.read.schema(L.RAW_SCHEMA).parquet(out).groupBy("model_version").agg(F.count("*").alias("n"))


@query("l2_incremental_append", _PROCESSED)
def incremental_append(spark, sf):
    """The stream runs twice, more files arriving in between; nothing is read twice."""
    folder = scratch_path(spark, "requests")
    cfg = _config(spark, sf, [folder])
    log, files = request_log(spark, sf), _log_files(spark, sf)
    for half in (0, 1):
        _write_log(log.where(F.col("log_id").cast("long") % 2 == half), files, folder)
        L.ingest(spark, cfg)
    L.ingest(spark, cfg)  # nothing new: no rows
    rows = spark.read.parquet(cfg.processed_path)
    return rows.select(*_OUT, stamp(F.col("timestamp")).alias("timestamp"))


def _user_stats(spark, sf) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n_events"))


_RECENT = f"""WITH {_RECORDS}, u AS (SELECT user_id, count(*) AS n_events FROM events GROUP BY user_id)
    SELECT md5(concat(event_id, '-', position)) AS example_id, strftime(ts, '%Y-%m-%d') AS date, value, n_events
    FROM rec LEFT JOIN u USING (user_id) WHERE ts >= DATE '2024-01-21'"""


@query("l3_late_information", _RECENT)
def late_information(spark, sf):
    """Recent rows joined to a table that is complete only on the second run."""
    users = _user_stats(spark, sf)
    cfg = _config(spark, sf, window_days=10)
    L.ingest(spark, cfg)
    for late in (users.where("user_id % 2 = 0"), users):
        step = J.LeftJoin(late, ["n_events"], ["user_id"])
        L.join_recent(spark, _with_joins(cfg, step), AS_OF)
    rows = spark.read.parquet(cfg.joined_path)
    return rows.select("example_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "value", "n_events")


def _with_joins(cfg, *steps):
    from dataclasses import replace

    return replace(cfg, joins=steps)


@query(
    "l4_incremental_metrics",
    f"""WITH {_RECORDS}
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, 'value' AS column_name, count(*) AS "count",
        count(*) - count(value) AS num_nulls, {R('avg(value)')} AS "avg", {R('stddev_samp(value)')} AS stddev FROM rec GROUP BY ALL""",
)
def incremental_metrics(spark, sf):
    """Partial aggregates per micro-batch, merged at the end."""
    cfg = _config(spark, sf)
    path = scratch_path(spark, "base")
    raw = L.read_request_stream(spark, cfg.log_paths, max_files=2)
    rows = K.process_requests(raw, FIELDS, PREDICTION, ["log_id"])
    spec = MonitorSpec(TimeSeries("timestamp"), ("1 day",), columns=("value",))
    L.update_metrics_stream(rows, spec, path, cfg.checkpoint_path)
    rows = L.merged_metrics(spark, path).where("column_name = 'value'")
    return flat(rows, "window", "column_name", "count", "num_nulls", "avg", "stddev")


@query(
    "l5_request_log_to_monitor",
    f"""WITH {_RECORDS}, m AS (SELECT date_trunc('day', ts) AS d, count(*) AS n, avg(value) AS mean,
        quantile_disc(value, 0.5) AS med FROM rec WHERE value > 1 GROUP BY 1)
    SELECT strftime(d, '%Y-%m-%d %H:%M:%S') AS window_start, 'value' AS column_name, n AS "count", {R('mean')} AS "avg",
        med AS median, {R('mean - lag(mean) OVER (ORDER BY d)')} AS avg_delta FROM m""",
)
def request_log_to_monitor(spark, sf):
    """Stream, filter, late join, upsert and monitor in one run."""
    step = J.LeftJoin(_user_stats(spark, sf), ["n_events"], ["user_id"])
    cfg = _config(spark, sf, filter_exp="value > 1", joins=(step,))
    spec = MonitorSpec(TimeSeries("timestamp"), ("1 day",), columns=("value", "n_events"))
    result = L.run_inference_log(spark, cfg, spec, AS_OF)
    keys = ["window", "column_name"]
    rows = result.analysis.join(result.drift.select(*keys, "avg_delta"), keys, "left")
    return flat(rows.where("column_name = 'value'"), *keys, "count", "avg", "median", "avg_delta")


@query(
    "b7_recent_partitions",
    "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM events WHERE ts >= DATE '2024-01-21' GROUP BY 1",
)
def recent_partitions(spark, sf):
    """The age limit reaches the partition filter of a date-partitioned table."""
    path = scratch_path(spark, "by-date")
    table(spark, sf, "events").withColumn("date", F.to_date("ts")).write.partitionBy("date").parquet(path)
    recent = spark.read.parquet(path).where(within_days(F.col("date"), 10, F.lit(AS_OF)))
    return recent.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("n"))
