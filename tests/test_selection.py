"""Exact order statistics and distinct counts against brute force."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import distinct as D
from tidemark.operators import selection as S

SCHEMA = "g string, h int, x double, y long"


def made(seed, n=4000):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        g = r.choice(["a", "b", None, "hot", "hot", "hot"])
        x = r.choice([None, 7.0, 7.0, 7.0, r.gauss(0, 5), r.gauss(0, 5), -0.0, float("inf"), float("-inf")])
        out.append((g, r.choice([1, None]), x, r.choice([None, r.randint(-50, 50), r.randint(-(2**40), 2**40)])))
    return out + [("nan", 1, float("nan"), None)] * 3 + [("nan", 1, 2.0, None), ("one", None, 3.0, 4), ("none", 1, None, None)]


def ordered(values):
    return sorted(values, key=lambda v: (math.isnan(v), v))


def brute(rows, ranks):
    out = {}
    for i, c in ((2, "x"), (3, "y")):
        groups = {}
        for r in rows:
            if r[i] is not None:
                groups.setdefault((r[0], r[1]), []).append(float(r[i]))
        for g, values in groups.items():
            out[(*g, c)] = tuple(repr(ordered(values)[rank(len(values)) - 1] + 0.0) for rank in ranks)
    return out


# The last error is far too small, so that bounds miss and columns are looked at again.
@pytest.mark.parametrize("seed,error", [(1, S.ERROR), (2, 0.5), (3, 0.0), (4, -0.2)])
def test_order_statistics(spark, seed, error):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    ranks = {"low": lambda n: F.greatest(F.lit(1), F.floor(n / 10)), "median": S.MEDIAN["median"], "top": lambda n: n}
    got = S.order_statistics(df, ["g", "h"], ["x", "y"], ranks, error=error).collect()
    want = brute(rows, [lambda n: max(1, n // 10), lambda n: -(-n // 2), lambda n: n])
    assert {(r[0], r[1], r[2]): tuple(repr(v + 0.0) for v in r[3:]) for r in got} == want
    assert len(got) == len(want)


def test_without_keys_and_empty(spark):
    df = spark.createDataFrame(made(5), SCHEMA)
    got = S.order_statistics(df, [], ["y"]).collect()
    values = sorted(r[3] for r in made(5) if r[3] is not None)
    assert [tuple(r) for r in got] == [("y", float(values[-(-len(values) // 2) - 1]))]
    assert S.order_statistics(df.limit(0), ["g"], ["x"]).collect() == []
    assert S.order_statistics(df.where("x IS NULL"), ["g"], ["x"]).collect() == []


def test_second_pass_keeps_few_rows(spark, monkeypatch):
    """Of a continuous column only the values near the rank are ordered."""
    seen = []
    original = S.running_by_group
    monkeypatch.setattr(S, "running_by_group", lambda counts, *a: seen.append(counts.count()) or original(counts, *a))
    df = spark.range(200_000).select((F.col("id") * 0.37 % 1000).alias("x"))
    assert S.order_statistics(df, [], ["x"]).count() == 1
    assert len(seen) == 1 and seen[0] < 200_000 * 4 * S.ERROR


def test_distinct_counts(spark):
    day = dt.date(2024, 1, 1)
    r = random.Random(2)
    rows = [
        (r.choice(["a", None]), r.choice([None, r.randint(-200, 200), r.choice([2**63 - 1, -(2**63)])]), r.choice([None, 0.0, -0.0, r.gauss(0, 1)]),
         r.choice([None, "", "x", "é", str(r.randint(0, 99))]), r.choice([None, day + dt.timedelta(days=r.randint(-90, 90))]), bytes([r.randint(0, 9)]))
        for _ in range(3000)
    ]
    df = spark.createDataFrame(rows, "g string, n long, x double, t string, d date, b binary")
    columns = ["n", "x", "t", "d", "b"]
    want = {}
    for i, c in enumerate(columns, 1):
        for g in ("a", None):
            want[g, c] = len({row[i] for row in rows if row[0] == g and row[i] is not None})
    whole = D.distinct_parts(df, ["g"], columns)
    batches = [D.distinct_parts(df.where(F.pmod(F.hash("n", "x"), F.lit(3)) == k), ["g"], columns) for k in range(3)]
    merged = D.merge_distinct_parts(batches[0].union(batches[1]).union(batches[2]).union(batches[0]), ["g"])
    for parts in (whole, merged):
        assert {(x[0], x[1]): x[2] for x in D.distinct_counts(parts, ["g"]).collect()} == want
    assert D.distinct_counts(D.distinct_parts(df.limit(0), ["g"], columns), ["g"]).collect() == []


def test_neighbouring_numbers_share_a_word(spark):
    parts = D.distinct_parts(spark.range(6400).select(F.lit(1).alias("g"), "id"), ["g"], ["id"])
    assert parts.count() == 100
