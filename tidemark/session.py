"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import os
import shutil
import site
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join is split even when that costs one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Sketches of so many groups are kept in a task's memory before it sorts instead.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1024",
    # Of a repeated key in a JSON object the last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job of this package assumes."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Hand the package to the Python workers, unless they find it where the driver did."""
    package = os.path.dirname(os.path.abspath(__file__))
    root, context = os.path.dirname(package), spark.sparkContext
    found = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages(), os.getcwd()]
    if root in map(os.path.abspath, filter(None, found)) or getattr(context, "_tidemark_shipped", False):
        return
    # The driver serves the archive to every executor as long as it runs.
    folder = tempfile.mkdtemp(prefix="tidemark-code-")
    context.addPyFile(shutil.make_archive(f"{folder}/tidemark-code", "zip", root, os.path.basename(package)))
    context._tidemark_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  A temporary folder is used
    only where that is unset and the session is local, as in tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


# Folders of the open scopes, innermost last.
_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{checkpoint_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are removed at the end.

    For jobs that leave their result in tables of their own; frames made inside must not
    be used afterwards.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch_name(name: str) -> str:
    """A table name of its own in the catalog."""
    return f"tidemark_{name}_{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, fixes the result of partition-dependent expressions, survives
    executor loss, and gives later joins real file sizes to plan with.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
