"""Reading and writing tables on plain columnar files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.joins import upsert
from tidemark.session import materialize


def read_parquet(spark: SparkSession, path: str, merge_schema: bool = False) -> DataFrame:
    return spark.read.option("mergeSchema", merge_schema).parquet(path)


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    sep: str = ",",
    header: bool = False,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Delimited text with given column names and types; blanks around values are cut.

    ``columns`` picks a subset, and only that is parsed.
    """
    df = (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("header", header)
        .option("ignoreLeadingWhiteSpace", True)
        .csv(path)
    )
    return df.select(*columns) if columns else df


def write_table(
    df: DataFrame, path: str, mode: str = "append", partition_by: Sequence[str] = ()
) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def save_table(
    df: DataFrame, name: str, mode: str = "overwrite", partition_by: Sequence[str] = (), path: str | None = None
) -> str:
    """Store ``df`` as a table of the catalog, in the warehouse or under a path of its own."""
    writer = df.write.mode(mode).partitionBy(*partition_by).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return name


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema`` first, missing ones as NULL, new ones last."""
    cols: list[Column] = []
    for f in schema.fields:
        source = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)
        cols.append(source.cast(f.dataType).alias(f.name))
    extra = [c for c in df.columns if c not in schema.names]
    return df.select(*cols, *[F.col(f"`{c}`") for c in extra])


def patterned_rows(
    spark: SparkSession,
    n: int | DataFrame,
    cycle: int = 10,
    labels: int = 10_000,
    null_every: int = 10,
    start: str = "2020-01-10",
) -> DataFrame:
    """Synthetic rows: days and moments in a cycle, a day with gaps, labels of given number.

    ``n`` is a number of rows, or a frame with an ``id`` column to derive them from.
    """
    ids = n if isinstance(n, DataFrame) else spark.range(n)
    step = F.pmod("id", F.lit(cycle)).cast("int")
    first = F.to_date(F.lit(start))
    day = F.date_format(F.date_add(first, step), "yyyy-MM-dd")
    moment = F.date_format(F.timestamp_seconds(F.unix_timestamp(first) + step), "yyyy-MM-dd HH:mm:ss")
    return ids.select(
        day.alias("day_text"),
        moment.alias("moment_text"),
        F.when(F.pmod("id", F.lit(null_every)) != 0, day).alias("gappy_day"),
        F.format_string("label %d", F.pmod("id", F.lit(labels))).alias("label"),
    )


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _file_system(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    target, fs = _file_system(spark, path)
    fs.delete(target, True)


def folders_of(df: DataFrame) -> list[str]:
    """Folders of the files that a frame reads, as addresses; a row for each comes to the driver."""
    path = F.col("_metadata.file_path")
    found = df.select(F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("folder")).distinct().collect()
    return [r["folder"] for r in found]


def remove_folder(spark: SparkSession, address: str) -> None:
    """Remove a folder by the address that ``folders_of`` gives, in which signs are escaped."""
    target = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(address))
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class SnapshotTable:
    """A table kept as a row of complete versions, so that it can be replaced by a
    result computed from itself.  The newest folder with a success marker is current."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        target, fs = _file_system(self.spark, self.path)
        if not fs.exists(target):
            return []
        found = []
        for status in fs.listStatus(target):
            name = status.getPath().getName()
            if name.startswith("v=") and exists(self.spark, f"{self.path}/{name}/_SUCCESS"):
                found.append(int(name[2:]))
        return sorted(found)

    def _folder(self, version: int) -> str:
        return f"{self.path}/v={version:08d}"

    def exists(self) -> bool:
        return bool(self.versions())

    def read(self, version: int | None = None) -> DataFrame:
        versions = self.versions()
        if not versions:
            raise FileNotFoundError(f"no version under {self.path}")
        return self.spark.read.parquet(self._folder(versions[-1] if version is None else version))

    def replace(self, df: DataFrame, version: int | None = None) -> int:
        """Write the next version, or the given one; readers see it once it is complete.

        The version before it is kept for readers that still use it.
        """
        versions = self.versions()
        if version is None:
            version = (versions or [0])[-1] + 1
        # A folder left by a write that failed has no success marker.
        df.write.mode("overwrite").parquet(self._folder(version))
        for old in [v for v in versions if v < version][:-1]:
            remove(self.spark, self._folder(old))
        return version

    def merge_schema(self, df: DataFrame) -> int:
        """Add rows that may bring new columns."""
        old = self.read()
        return self.replace(old.unionByName(df, allowMissingColumns=True))

    def copy_to(self, path: str) -> "SnapshotTable":
        """An independent copy of the current version."""
        copy = SnapshotTable(self.spark, path)
        copy.replace(self.read())
        return copy

    def drop(self) -> None:
        remove(self.spark, self.path)


def among(columns: Sequence[str], values: Sequence[tuple]) -> Column:
    """The columns hold one of the tuples of values, as a condition on literals."""
    out = F.lit(False)
    for row in values:
        equal = [F.col(f"`{c}`").eqNullSafe(F.lit(v)) for c, v in zip(columns, row)]
        out = out | reduce(lambda a, b: a & b, equal)
    if len(columns) == 1 and all(row[0] is not None for row in values):
        out = F.col(f"`{columns[0]}`").isin([row[0] for row in values])
    return out


def upsert_partitions(
    spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str], partition_col: str
) -> None:
    """Upsert into a partitioned folder, rewriting only the partitions the source has.

    ``partition_col`` must be one of the keys, so a row never changes partition.
    """
    if partition_col not in keys:
        raise ValueError(f"{partition_col!r} must be one of the keys")
    source = materialize(source, "upsert-source")
    if not exists(spark, path):
        source.write.partitionBy(partition_col).parquet(path)
        return
    column_type = source.schema[partition_col].dataType
    schema = T.StructType(
        [f for f in spark.read.parquet(path).schema.fields if f.name != partition_col]
        + [T.StructField(partition_col, column_type)]
    )
    # As many values as there are partitions; as literals they prune the scan.
    parts = [tuple(r) for r in source.select(partition_col).distinct().collect()]
    touched = spark.read.schema(schema).parquet(path).where(among([partition_col], parts))
    merged = materialize(upsert(touched, source, keys), "upsert")
    (
        merged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition_col)
        .parquet(path)
    )
