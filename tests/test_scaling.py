"""What a task holds must not grow with the table."""

from tidemark.queries import refresh_queries as Q
from tidemark.queries import registry


def _largest(df) -> int:
    from pyspark.sql import functions as F

    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def _table(spark, tmp_path, n: int) -> str:
    rows = spark.range(n).selectExpr("id AS l_orderkey", "timestamp_seconds(800000000 + id * 60) AS l_shipdate")
    rows.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_dealt_by_rows(spark, tmp_path):
    sf = _table(spark, tmp_path, 40_000)
    rows = registry.dealt(registry.table(spark, sf, "lineitem"), "l_orderkey", rows=1_000)
    assert _largest(rows) <= 1_500
    assert rows.count() == 40_000


def test_dealt_to_every_core(spark, tmp_path):
    sf = _table(spark, tmp_path, 1_000)
    rows = registry.dealt(registry.table(spark, sf, "lineitem"), "l_orderkey")
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_stored_files_by_rows(spark, tmp_path, monkeypatch):
    sf = _table(spark, tmp_path, 40_000)
    monkeypatch.setattr(registry.tasks_of, "__defaults__", (1_000,))
    name = Q._stored(registry.table(spark, sf, "lineitem"), sf)
    assert len(spark.table(name).inputFiles()) == 40
    assert spark.table(name).count() == 40_000


def test_log_files_of_many_blocks(spark, tmp_path):
    """A stream reads few files at a time, so a file must be more than one task."""
    import pyarrow.parquet as pq

    from tidemark.queries import requests

    log = spark.range(200_000).selectExpr("CAST(id AS STRING) AS log_id", "sha2(CAST(id AS STRING), 256) AS request")
    requests._write_log(log, 2, f"{tmp_path}/log")
    files = [p.replace("file://", "") for p in spark.read.parquet(f"{tmp_path}/log").inputFiles()]
    assert len(files) == 2
    assert all(pq.ParquetFile(f).num_row_groups > 2 for f in files)


def test_pairs_of_bytes_are_those_of_columns(spark):
    """The sums over bytes against the pairs as column expressions, on odd texts."""
    from pyspark.sql import functions as F

    from tidemark.operators import kinds as N

    texts = [None, "", " ", "a", "Ab c", "~~", "é~é", "ééa", " \0x\0 ", "1 2 3", "naïve  Ünder~tow", "ab\n\tcd", "z" * 3000, "日本 word", "KK"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    model = N.LanguageModel(tuple(((i * 37) % 101) / 7 for i in range(len(N.SYMBOLS) ** 2)))
    got = {r["i"]: r["e"] for r in df.select("i", model.evidence(F.col("t")).alias("e")).collect()}
    for r in df.where("t IS NOT NULL").select("i", N.symbol_pairs(F.col("t")).alias("p")).collect():
        total = 0.0
        for p in r["p"]:
            total += round(model.ratios[p], 6)
        assert (got[r["i"]]["pairs"], round(got[r["i"]]["total"], 9)) == (len(r["p"]), round(total, 9)), texts[r["i"]]


def test_language_is_fitted_from_the_same_pairs(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import kinds as N

    rows = [("The cat", True), ("el gato~", False), ("", True), (None, True), ("ignored", None), ("Über", False)]
    df = spark.createDataFrame(rows, "t string, y boolean")
    plan = N.fit_language(df, "t", F.col("y"))
    pairs = df.where("t IS NOT NULL AND y IS NOT NULL").select("y", F.explode(N.symbol_pairs(F.col("t"))).alias("p"))
    n = {(r["y"], r["p"]): r["count"] for r in pairs.groupBy("y", "p").count().collect()}
    import math

    size = len(N.SYMBOLS) ** 2
    of = {y: sum(v for (z, _), v in n.items() if z == y) for y in (True, False)}
    want = [math.log((n.get((True, i), 0) + 1) / (of[True] + size)) - math.log((n.get((False, i), 0) + 1) / (of[False] + size)) for i in range(size)]
    assert max(abs(a - b) for a, b in zip(plan.ratios, want)) < 1e-12
