import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup as L

SCHEMA = "doc_id long, text string"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, min_length=40, min_docs=5):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key_of(line)].add(doc)
    last = {
        k: max(d, key=lambda x: (x is not None, x or 0))
        for k, d in holders.items()
        if len(k) >= min_length and len(d) >= min_docs
    }
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key_of(x) not in last or last[key_of(x)] == doc]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((doc, len(lines), len(lines) - len(kept), digest))
    return sorted(out, key=repr)


def check(spark, rows, parts=3, **limits):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = [tuple(r) for r in L.report(df, **limits).collect()]
    assert sorted(got, key=repr) == brute(rows, *limits.values())
    return got


def made(seed, n, pool=30):
    r = random.Random(seed)
    common = [f"line {i} " + "x" * r.randint(20, 60) for i in range(pool)]
    out = []
    for i in range(n):
        lines = [
            r.choice(["", " ", "\t"]) + (r.choice(common).upper() if r.random() < 0.3 else r.choice(common))
            if r.random() < 0.5 else f"own {i} {r.random()} " + "y" * 40
            for _ in range(r.randint(0, 150))
        ]
        out.append((i, "\n".join(lines)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_random_lines(spark, seed):
    got = check(spark, made(seed, 60), 5)
    assert sum(r[2] for r in got) > 100


def test_lines_over_borders_of_tasks(spark):
    """One line on most rows fills many tasks."""
    hot = "the very same line in most of the documents here " * 2
    rows = [(i, f"{hot}\nown line of document {i} that nobody else has at all\n{hot}") for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        parts = L.ranged(L.hashed_lines(df.toDF("id", "text")))
        borders = L.over_borders(parts).collect()
        assert [(r["all_docs"], r["all_last"]) for r in borders if r["all_docs"] > 1] == [(300, 299)]
        sizes = [r["count"] for r in parts.groupBy("task").count().collect()]
        assert len(sizes) > 8 and max(sizes) < 200
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_bounds(spark):
    at, under = "é" * 40, "é" * 39
    rows = [(i, f"{at}\n{under}") for i in range(5)] + [(10 + i, "z" * 40) for i in range(4)]
    got = check(spark, rows)
    assert sorted(r[2] for r in got) == [0] * 5 + [1] * 4
    check(spark, rows, min_length=39, min_docs=2)


def test_stripping_and_case(spark):
    base = "some line with letters and É that is long enough"
    rows = [(1, base), (2, f" \t{base}\x0b\x0c"), (3, base.upper().replace("É", "É")), (4, f"{base}\r"), (5, base),
            (6, f"\x1c{base}"), (7, f"\xa0{base}"), (8, base.replace("É", "é")), (9, base.lower())]
    check(spark, rows)


def test_odd_rows(spark):
    same = "a line of more than forty characters for all of them"
    rows = [(None, same), (None, f"{same}\n{same}"), (None, None), (1, None), (2, ""), (2, "\n\n"), (3, same), (3, f"x\n{same}"),
            (3, same), (4, f"{same}\n" * 200), (5, same), (6, same), (6, f"{same}\nlast\n{same}\n"), (7, "word " * 100_000),
            (8, "\n".join(f"{same}" if i % 3 else f"{i}" for i in range(5000))), (9, "\n")]
    check(spark, rows)
    check(spark, [r for r in rows if r[0] is None or r[0] < 5] + [(None, same)])
    df = spark.createDataFrame(rows, SCHEMA)
    assert L.report(df.limit(0)).collect() == []


def test_copies_of_a_row(spark):
    same = "a line of more than forty characters for all of them"
    rows = [(1, f"{same}\nx")] * 50 + [(i, same) for i in range(2, 7)]
    check(spark, rows, 4)


def test_columns_stay(spark):
    same = "a line of more than forty characters for all of them"
    rows = [(i, f"{same}\n{i}", "k", 1.0) for i in range(6)] + [(9, None, "k", 2.0)]
    df = spark.createDataFrame(rows, "doc_id int, text string, keep string, _bits double")
    out = L.deduplicated(df)
    assert out.columns == df.columns and out.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {**{i: str(i) for i in range(5)}, 5: f"{same}\n5", 9: None}
    extra = df.withColumns({"KEY": F.lit(1), "id": F.lit(2), "n_lines": F.lit(3)})
    assert L.report(extra).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


def test_no_python_worker(spark, small):
    plan = L.report(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
