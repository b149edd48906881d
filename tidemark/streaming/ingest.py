"""Request-log streams: read, process, append, enrich, and keep metrics up to date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.dates import within_days
from tidemark.operators.joins import LeftJoin, join_chain
from tidemark.operators.payloads import process_requests
from tidemark.plans.refresh import (
    MonitorResult,
    aggregate_base,
    finish_aggregate_base,
    merge_aggregate_base,
    monitor,
)
from tidemark.sources.tables import SnapshotTable, exists, remove, upsert_partitions
from tidemark.spec import MonitorSpec

RAW_SCHEMA = T.StructType(
    [
        T.StructField("log_id", T.StringType()),
        T.StructField("request", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("model_version", T.StringType()),
    ]
)


def read_request_stream(
    spark: SparkSession,
    paths: Sequence[str],
    schema: T.StructType = RAW_SCHEMA,
    max_files: int | None = None,
) -> DataFrame:
    """One stream over all logging folders that exist; an error if none does.

    ``max_files`` bounds a micro-batch.
    """
    found = [p for p in paths if exists(spark, p)]
    if not found:
        raise FileNotFoundError(f"no request log under {list(paths)}")

    def stream(path: str) -> DataFrame:
        reader = spark.readStream.schema(schema)
        if max_files is not None:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return reader.parquet(path)

    frames = [stream(p) for p in found]
    out = frames[0]
    for other in frames[1:]:
        out = out.union(other)
    return out


def append_available(stream: DataFrame, path: str, checkpoint: str, partition_col: str = "date") -> None:
    """Append everything that has arrived, once, and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy(partition_col)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


@dataclass(frozen=True)
class InferenceConfig:
    """Everything a run needs: where the data is and what it looks like."""

    log_paths: Sequence[str]
    processed_path: str
    joined_path: str
    checkpoint_path: str
    request_fields: T.StructType
    response_field: T.StructField
    id_cols: Sequence[str] = ("log_id",)
    filter_exp: str | None = None
    joins: Sequence[LeftJoin] = field(default_factory=tuple)
    window_days: int = 365
    max_files: int | None = None
    raw_schema: T.StructType = RAW_SCHEMA


def ingest(spark: SparkSession, cfg: InferenceConfig) -> None:
    """New log rows, unpacked and filtered, appended to the processed table."""
    raw = read_request_stream(spark, cfg.log_paths, cfg.raw_schema, cfg.max_files)
    rows = process_requests(raw, cfg.request_fields, cfg.response_field, list(cfg.id_cols))
    if cfg.filter_exp:
        rows = rows.where(F.expr(cfg.filter_exp))
    append_available(rows, cfg.processed_path, cfg.checkpoint_path)


def join_recent(spark: SparkSession, cfg: InferenceConfig, as_of: dt.date | None = None) -> None:
    """Re-join recent rows with information that arrived late, and upsert them.

    The age limit is on the partition column, so older partitions are not read; the
    upsert rewrites only the partitions it touches.
    """
    today = F.lit(as_of) if as_of is not None else None
    recent = spark.read.parquet(cfg.processed_path).where(
        within_days(F.col("date"), cfg.window_days, today)
    )
    enriched = join_chain(recent, list(cfg.joins))
    upsert_partitions(spark, cfg.joined_path, enriched, ["date", "example_id"], "date")


def run_inference_log(
    spark: SparkSession, cfg: InferenceConfig, spec: MonitorSpec, as_of: dt.date | None = None
) -> MonitorResult:
    """Ingest, enrich and monitor in one go."""
    ingest(spark, cfg)
    join_recent(spark, cfg, as_of)
    return monitor(spark.read.parquet(cfg.joined_path), spec)


def update_metrics_stream(stream: DataFrame, spec: MonitorSpec, path: str, checkpoint: str) -> None:
    """Partial aggregates of every micro-batch, one folder per batch, compacted at the end.

    A batch that runs again replaces its own folder, so nothing is counted twice.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        part = aggregate_base(batch, spec)
        part.write.mode("overwrite").parquet(f"{path}/batches/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    compact_metrics(stream.sparkSession, path)


def _parts(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None, int]:
    """The compacted base, the batches after it, and the last batch in the base."""
    base = SnapshotTable(spark, f"{path}/base")
    rows = base.read() if base.exists() else None
    upto = -1 if rows is None else rows.agg(F.max("upto")).first()[0]
    rows = None if rows is None else rows.drop("upto")
    batches = None
    if exists(spark, f"{path}/batches"):
        reader = spark.read
        if rows is not None:  # no folder of a batch may be left
            reader = reader.schema(T.StructType([*rows.schema.fields, T.StructField("batch", T.IntegerType())]))
        batches = reader.parquet(f"{path}/batches").where(F.col("batch") > upto)
    return rows, batches, upto


def _merged(base: DataFrame | None, batches: DataFrame | None) -> DataFrame:
    parts = [p for p in (base, None if batches is None else batches.drop("batch")) if p is not None]
    if not parts:
        raise FileNotFoundError("no batch so far")
    return merge_aggregate_base(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))


def compact_metrics(spark: SparkSession, path: str) -> None:
    """Merge the batches into one base; a stop at any point loses and doubles nothing.

    The base says which batches it holds, and readers leave those out; their folders are
    removed afterwards.
    """
    base, batches, upto = _parts(spark, path)
    ids = [] if batches is None else sorted(r[0] for r in batches.select("batch").distinct().collect())
    if ids:
        rows = _merged(base, batches).withColumn("upto", F.lit(int(ids[-1])))
        SnapshotTable(spark, f"{path}/base").replace(rows)
    for done in ids:
        remove(spark, f"{path}/batches/batch={done}")


def merged_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics over all batches so far, without reading the data again."""
    base, batches, _ = _parts(spark, path)
    return finish_aggregate_base(_merged(base, batches))
