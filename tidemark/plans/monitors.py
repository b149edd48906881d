"""Life of a monitor: create, update, refresh, look up, delete."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import spec as S
from tidemark.functions.columns import row_hash
from tidemark.operators.joins import conflicting_labels, log_labels
from tidemark.plans import refresh as R
from tidemark.plans.files import file_changes, listing, of_files
from tidemark.session import materialize, scratch_scope
from tidemark.sources.tables import SnapshotTable, among, conform, exists, folders_of, remove, remove_folder

_SPEC_SCHEMA = "table_name string, baseline_table_name string, linked_entities array<string>, spec string"


class MonitorError(Exception):
    """A monitor request that cannot be met; ``code`` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class MonitorInfo:
    table_name: str
    baseline_table_name: str | None
    linked_entities: tuple[str, ...]
    spec: S.MonitorSpec
    analysis_metrics_path: str
    drift_metrics_path: str


def spec_to_json(spec: S.MonitorSpec) -> str:
    body = asdict(spec)
    body["analysis"] = {"kind": type(spec.analysis).__name__, **asdict(spec.analysis)}
    return json.dumps(body, sort_keys=True)


def spec_from_json(text: str) -> S.MonitorSpec:
    body = json.loads(text)
    analysis = body.pop("analysis")
    kinds = {c.__name__: c for c in (S.GenericTable, S.TimeSeries, S.InferenceLog)}
    body["analysis"] = kinds[analysis.pop("kind")](**analysis)
    body["custom_metrics"] = tuple(S.Metric(**m) for m in body["custom_metrics"])
    return S.MonitorSpec(**body)


class Monitors:
    """Monitors over named tables; specs and output tables live under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._specs = SnapshotTable(spark, f"{self.root}/specs")

    # specs ---------------------------------------------------------------

    def specs(self) -> DataFrame:
        """One row per monitor."""
        if self._specs.exists():
            return self._specs.read()
        return self.spark.createDataFrame([], _SPEC_SCHEMA)

    def _store(self, info: MonitorInfo) -> None:
        row = (
            info.table_name,
            info.baseline_table_name,
            list(info.linked_entities),
            spec_to_json(info.spec),
        )
        others = self.specs().where(F.col("table_name") != info.table_name)
        self._specs.replace(others.unionByName(self.spark.createDataFrame([row], _SPEC_SCHEMA)))

    def _folder(self, table_name: str) -> str:
        return f"{self.root}/monitor={table_name}"

    def _info(self, row: T.Row) -> MonitorInfo:
        folder = self._folder(row.table_name)
        return MonitorInfo(
            row.table_name,
            row.baseline_table_name,
            tuple(row.linked_entities or ()),
            spec_from_json(row.spec),
            f"{folder}/analysis_metrics",
            f"{folder}/drift_metrics",
        )

    def info(self, table_name: str) -> MonitorInfo:
        row = self.specs().where(F.col("table_name") == table_name).first()
        if row is None:
            raise MonitorError("MONITOR_NOT_FOUND", f"no monitor on {table_name}")
        return self._info(row)

    def by_entity(self, entity: str) -> DataFrame:
        return self.specs().where(F.array_contains("linked_entities", entity)).select("table_name")

    def create_or_update(
        self,
        table_name: str,
        spec: S.MonitorSpec,
        baseline_table_name: str | None = None,
        linked_entities: Sequence[str] = (),
        skip_analysis: bool = False,
        as_of: dt.datetime | None = None,
    ) -> MonitorInfo:
        """Store the monitor and, unless told not to, analyse the table at once."""
        self._check(table_name, spec)
        folder = self._folder(table_name)
        info = MonitorInfo(
            table_name, baseline_table_name, tuple(linked_entities), spec,
            f"{folder}/analysis_metrics", f"{folder}/drift_metrics",
        )
        self._store(info)
        if not skip_analysis:
            self.refresh(table_name, backfill=True, as_of=as_of)
        return info

    def _check(self, table_name: str, spec: S.MonitorSpec) -> None:
        """Columns the spec names must exist."""
        have = set(self.spark.table(table_name).columns)
        named = {v for k, v in asdict(spec.analysis).items() if k.endswith("_col") and v}
        missing = sorted((named | set(spec.columns or ())) - have)
        if missing:
            raise MonitorError("INVALID_PARAMETER", f"{table_name} has no column {missing}")
        for text in spec.slicing_exprs:
            self.spark.table(table_name).select(F.expr(text))

    def update(self, table_name: str, **params: Any) -> MonitorInfo:
        """Change the named parameters; the others stay."""
        info = self.info(table_name)
        outer = {k: params.pop(k) for k in ("baseline_table_name", "linked_entities") if k in params}
        changed = MonitorInfo(
            info.table_name,
            outer.get("baseline_table_name", info.baseline_table_name),
            tuple(outer.get("linked_entities", info.linked_entities)),
            info.spec.with_params(**params),
            info.analysis_metrics_path,
            info.drift_metrics_path,
        )
        self._check(table_name, changed.spec)
        self._store(changed)
        return changed

    # metrics -------------------------------------------------------------

    def _tables(self, info: MonitorInfo) -> tuple[SnapshotTable, SnapshotTable, int]:
        """Analysis, drift and the last version that is complete in both; 0 if none is.

        Both are written with one version number, so a refresh that fails between them
        leaves the versions before it in use.
        """
        paths = (info.analysis_metrics_path, info.drift_metrics_path)
        analysis, drift = (SnapshotTable(self.spark, p) for p in paths)
        return analysis, drift, max({*analysis.versions()} & {*drift.versions()}, default=0)

    def analysis(self, table_name: str) -> DataFrame:
        analysis, _, version = self._tables(self.info(table_name))
        return analysis.read(version or None)

    def drift(self, table_name: str) -> DataFrame:
        _, drift, version = self._tables(self.info(table_name))
        return drift.read(version or None)

    def refresh(
        self,
        table_name: str,
        backfill: bool = False,
        changed: DataFrame | None = None,
        as_of: dt.datetime | None = None,
    ) -> None:
        """Bring the metric tables up to date.

        Only windows whose rows have changed since the last refresh are recomputed, and
        those drift compares with them.  Of a table on files they are found by the files that
        are new or gone, of a view by the marks of the last refresh; or they are given by
        ``changed``, the rows added, altered or removed.  New columns and
        metrics appear in recomputed windows; ``backfill`` recomputes all.  A table without
        time gets one more window.
        """
        info = self.info(table_name)
        with scratch_scope(self.spark):
            self._refresh(info, backfill, changed, as_of)

    def _refresh(self, info: MonitorInfo, backfill: bool, changed: DataFrame | None, as_of: dt.datetime | None) -> None:
        folder = self._folder(info.table_name)
        analysis, drift, version = self._tables(info)
        base, moved_base = self._baseline(info)
        if info.spec.timestamp_col is None:
            counts = SnapshotTable(self.spark, f"{folder}/value_counts")
            self._refresh_snapshot(info, self.spark.table(info.table_name), base, as_of, counts)
            return
        df, on_files = self._watched(info.table_name)
        seen = SnapshotTable(self.spark, f"{folder}/{'files' if on_files else 'seen'}")
        before = seen.read() if seen.exists() else None
        if on_files:
            state, touched = file_changes(df, info.spec, before)
        else:
            state = materialize(R.window_marks(df, info.spec), "marks")
            touched = None if before is None else R.moved_windows(before, state)
        # A baseline that has changed is compared with every window anew.
        if backfill or moved_base or not version or (before is None and changed is None):
            stage = R.run_stages(df, info.spec, as_of=as_of)
            rows, moved = stage.metrics, R.drift_stage(stage, info.spec, base)
        else:
            if changed is not None:
                touched = R.touched_windows(changed, info.spec)
            touched, files = materialize(touched, "touched"), state if on_files else None
            old = analysis.read(version).where(F.col("log_type") == S.INPUT)
            rows = materialize(R.refresh_analysis(df, info.spec, old, touched, files), "analysis")
            moved = R.refresh_drift(df, info.spec, drift.read(version), rows, touched, base, files)
        drift.replace(moved, version + 1)
        whole = rows if base is None else rows.unionByName(base.metrics, allowMissingColumns=True)
        analysis.replace(whole, version + 1)
        # Last, so that a refresh that fails is done again.
        seen.replace(state)

    def _watched(self, table_name: str) -> tuple[DataFrame, bool]:
        """A table as it is now, and whether its files tell what has changed."""
        on_files = of_files(self.spark, table_name)
        if on_files:
            self.spark.catalog.refreshTable(table_name)
        return self.spark.table(table_name), on_files

    def _baseline(self, info: MonitorInfo) -> tuple[R.Stage | None, bool]:
        """The baseline's metrics and counts, computed once for a spec and a state of the
        table, and whether that was now."""
        if not info.baseline_table_name:
            return None, False
        df, on_files = self._watched(info.baseline_table_name)
        # The files' names, sizes and times, or else all rows.
        rows = listing(df) if on_files else df
        state = rows.agg(F.count("*"), F.sum(row_hash(rows).cast("decimal(38,0)"))).first()
        text = "|".join([info.baseline_table_name, spec_to_json(info.spec), str(df.dtypes), *map(str, state)])
        root = f"{self._folder(info.table_name)}/baseline"
        folder = f"{root}/{hashlib.md5(text.encode()).hexdigest()}"
        parts = [SnapshotTable(self.spark, f"{folder}/{name}") for name in ("metrics", "counts")]
        fresh = not all(p.exists() for p in parts)
        if fresh:
            stage = R.run_stages(df, info.spec, S.BASELINE)
            remove(self.spark, root)
            for part, rows in zip(parts, stage):
                part.replace(rows)
        return R.Stage(*[p.read() for p in parts]), fresh

    def _refresh_snapshot(self, info, df, base, as_of, counts) -> None:
        """One more window; value counts of the last one are kept for the comparison."""
        analysis, drift, version = self._tables(info)
        stage = R.run_stages(df, info.spec, as_of=as_of)
        stage = R.Stage(stage.metrics, materialize(stage.counts, "counts"))
        scored = stage.metrics
        seen = stage.counts
        if version:
            old = analysis.read(version).where(F.col("log_type") == S.INPUT)
            scored = old.unionByName(scored, allowMissingColumns=True)
            last = old.agg(F.max("window")).first()[0]
            if counts.exists() and last is not None:
                seen = counts.read().unionByName(stage.counts)
        scored = materialize(scored, "analysis")
        rows = R.drift_stage(R.Stage(scored, seen), info.spec, base)
        newest = scored.agg(F.max("window")).scalar()
        fresh = rows.where(F.col("window") == newest)
        if version:
            fresh = drift.read(version).unionByName(fresh, allowMissingColumns=True)
        drift.replace(fresh, version + 1)
        whole = scored if base is None else scored.unionByName(base.metrics, allowMissingColumns=True)
        analysis.replace(whole, version + 1)
        counts.replace(stage.counts)

    def delete(self, table_name: str, purge_artifacts: bool = False) -> None:
        info = self.info(table_name)
        if purge_artifacts:
            for name in ("analysis_metrics", "drift_metrics", "value_counts", "baseline", "seen", "files"):
                SnapshotTable(self.spark, f"{self._folder(table_name)}/{name}").drop()
        self._specs.replace(self.specs().where(F.col("table_name") != table_name))


_PARTITIONS = ["log_type", "model_version", "batch_id"]


class LoggingTable:
    """Baseline rows, scored rows and late labels of one model in a typed table.

    The folder is partitioned by log type, version and batch: logging appends a
    partition, and only partitions with newly labelled rows are rewritten.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, id_cols: Sequence[str]):
        self.spark, self.path, self.id_cols = spark, path.rstrip("/"), list(id_cols)
        self.payload = T.StructType([f for f in schema.fields if f.name not in _PARTITIONS])
        self.schema = T.StructType(
            self.payload.fields + [T.StructField(n, T.StringType()) for n in _PARTITIONS]
        )

    def _append(self, df: DataFrame, log_type: str, version: str, batch_id: str, replace: bool = False) -> str:
        missing = [f.name for f in self.payload.fields if not f.nullable and f.name not in df.columns]
        unknown = [c for c in df.columns if c not in self.payload.names]
        if missing or unknown:
            raise ValueError(f"missing columns {missing}, unknown columns {unknown}")
        tags = zip(_PARTITIONS, (log_type, version, batch_id))
        rows = conform(df, self.payload).withColumns({k: F.lit(v) for k, v in tags})
        # A batch that replaces itself is complete before the files it replaces go.
        writer = rows.write.mode("overwrite" if replace else "append").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*_PARTITIONS).parquet(self.path)
        return batch_id

    def _batches(self, log_type: str, version: str) -> DataFrame:
        return self.read().where((F.col("log_type") == log_type) & (F.col("model_version") == version))

    def log_baseline(self, df: DataFrame, version: str, batch_id: str) -> str:
        """Baseline of a version; logging it again replaces it.

        The new batch is written first, so a write that fails leaves the old ones.
        """
        new = materialize(df, "baseline")
        others: list[str] = []
        if exists(self.spark, self.path):
            others = folders_of(self._batches(S.BASELINE, version).where(F.col("batch_id") != batch_id))
        self._append(new, S.BASELINE, version, batch_id, replace=True)
        for other in others:
            remove_folder(self.spark, other)
        return batch_id

    def log_scored(self, df: DataFrame, version: str, batch_id: str) -> str:
        return self._append(df, S.INPUT, version, batch_id)

    def log_labels(self, labels: DataFrame, label_col: str) -> int:
        """Fill labels of scored rows by id; returns the number of rows that changed."""
        labels = materialize(labels.select(*self.id_cols, label_col), "labels")
        if not conflicting_labels(labels, self.id_cols, label_col).isEmpty():
            raise ValueError(f"an id is given different labels in {label_col!r}")
        only = f"log_type = '{S.INPUT}'"
        logged = self.read()
        hit = logged.where(only).join(labels.select(*self.id_cols), self.id_cols, "left_semi")
        # As many rows as there are batches with labels; as literals they prune the scan.
        parts = [tuple(r) for r in hit.select(*_PARTITIONS).distinct().collect()]
        if not parts:
            return 0
        touched = logged.where(among(_PARTITIONS, parts))
        filled = materialize(log_labels(touched, labels, self.id_cols, label_col, only), "labels")
        (
            filled.select(*self.schema.names)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*_PARTITIONS)
            .parquet(self.path)
        )
        return filled.where("_updated").count()

    def remove_batch(self, log_type: str, version: str, batch_id: str) -> None:
        for folder in folders_of(self._batches(log_type, version).where(F.col("batch_id") == batch_id)):
            remove_folder(self.spark, folder)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)
