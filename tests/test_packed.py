"""Values packed by cell and bucket, against loops."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import packed as K

COLUMNS = ["w", "x", "t", "d"]


@pytest.fixture(scope="module")
def cells(spark):
    """Large and negative numbers, NaN, zeros of both signs, NULLs, an empty text; groups that overlap."""
    real = "CASE WHEN id % 9 = 0 THEN NULL WHEN id % 31 = 0 THEN double('NaN') WHEN id % 10 = 1 THEN -0.0D WHEN id % 10 = 2 THEN 0.0D ELSE (id * 37 % 211 - 100) / 7 END"
    return spark.range(3000).selectExpr(
        "array(0L, 10 + id % 3, CASE WHEN id % 2 = 0 THEN 0L ELSE 20L END) AS _gids",
        "CASE WHEN id % 5 > 0 THEN 9007199254740993L + id % 400 - id % 2 * 9223372036854775807L END AS w",
        f"{real} AS x",
        "CASE WHEN id % 7 > 0 THEN repeat('a', CAST(id % 40 AS INT)) END AS t",
        "date_add(DATE'1969-12-01', CAST(id % 60 AS INT)) AS d",
    )


@pytest.mark.parametrize("rows", [10**6, 150])
def test_distinct_counts_and_medians_of_groups(spark, cells, monkeypatch, rows):
    monkeypatch.setattr(K, "BUCKET_ROWS", rows)
    monkeypatch.setattr(K, "BLOCK_ROWS", 4 * rows)
    blobs, buckets = K.packed(cells.repartition(3), COLUMNS)
    assert buckets == max(1, 3000 // rows) and blobs.count() >= buckets
    kinds = K.packed_kinds(cells, COLUMNS)
    sizes = K.bucket_sizes(blobs, buckets, kinds)
    distinct = {(r[0], r[1]): r[2] for r in K.distinct_of_packed(sizes, COLUMNS).collect()}
    found = K.medians_of_packed(blobs, buckets, sizes, kinds, COLUMNS, ["w", "x"]).collect()
    medians = {(r[0], r[1]): r[2] for r in found}
    values: dict = {}
    for r in cells.collect():
        for c in COLUMNS:
            if r[c] is not None:
                for g in r["_gids"]:
                    values.setdefault((g, c), []).append(math.inf if isinstance(r[c], float) and math.isnan(r[c]) else r[c])
    assert distinct == {k: len(set(v)) for k, v in values.items()}
    assert set(medians) == {k for k in values if k[1] in ("w", "x")} and len(found) == len(medians)
    for k, v in medians.items():
        assert (math.inf if math.isnan(v) else v) == float(sorted(values[k])[(len(values[k]) + 1) // 2 - 1]), k


def test_nothing_to_pack(spark, cells):
    for empty in (cells.limit(0), cells.where("x IS NULL")):
        blobs, buckets = K.packed(empty, ["x"])
        sizes = K.bucket_sizes(blobs, buckets, ["real"])
        assert sizes.count() == 0 and K.distinct_of_packed(sizes, ["x"]).count() == 0
        assert K.medians_of_packed(blobs, buckets, sizes, ["real"], ["x"], ["x"]).count() == 0


def test_hot_values_are_one_row_of_a_block(spark):
    """A value that many rows hold is packed once for each cell."""
    rows = spark.range(200_000).select(F.array(F.col("id") % 2).alias("_gids"), F.lit(5.0).alias("x"))
    blobs, buckets = K.packed(rows, ["x"])
    assert blobs.agg(F.sum(F.length("blob"))).first()[0] < 10_000 * blobs.count()
    sizes = K.bucket_sizes(blobs, buckets, ["real"]).collect()
    assert sorted((r._gid, r.rows, r.distinct) for r in sizes) == [(0, 100_000, 1), (1, 100_000, 1)]
