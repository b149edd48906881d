import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import manifest as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    out = ""
    for value in (row[0], row[3], row[2], None if row[4] is None else row[4] + more, row[1]):
        out += "-" if value is None else f"{len(str(value).encode())}:{value}"
    return sha(out)


def fold_up(nodes, width):
    """The top node, and for each leaf its siblings left and right on every level."""
    paths, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        parents, below = [], []
        for s in range(0, len(nodes), width):
            run = nodes[s : s + width]
            for k in range(len(run)):
                for i in at[s + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            parents.append(sha("".join(run)))
            below.append([i for k in range(len(run)) for i in at[s + k]])
        nodes, at = parents, below
    return nodes[0], paths


def brute(rows, width=2):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, held = [], []
    for lang in langs:
        ordered = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, paths = fold_up([leaf(r) for r in ordered], width)
        tops.append(top)
        held.append((ordered, paths))
    if not tops:
        return []
    root, upper = fold_up(tops, width)
    out = []
    for (ordered, paths), top, above in zip(held, tops, upper):
        for row, path in zip(ordered, paths):
            path = path + above
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = leaf(row, int(changed))
            for left, right in path:
                node = sha(left + node + right)
            proof = sha("".join(left + right for left, right in path))
            out.append((row[0], leaf(row), top, root, proof, node, node == root))
    return out


def check(df, width=2):
    rows = [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = [tuple(r) for r in M.report(df, width).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, width), key=repr)
    return got


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (3, 1, 5), (255, 256, 257), (513, 40)])
def test_shapes(spark, sizes):
    rows = [(i * 9 + g, f"text {i}", [None, "en", "é", "z", ""][g], "s", i) for g, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    check(spark.createDataFrame(rows, SCHEMA).repartition(5))


def test_two_rounds_and_many_groups(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_NODES", 4)
    rows = [(i, f"t{i}", f"l{i % 19}" if i % 3 else "hot", "s", i) for i in range(400)]
    got = check(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert 0 < sum(not r[-1] for r in got) < 120


@pytest.mark.parametrize("width", [3, 10])
def test_wider_runs(spark, width):
    rows = [(i, f"t{i}", "ab"[i % 5 == 0], "s", i) for i in range(270)]
    check(spark.createDataFrame(rows, SCHEMA), width)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (None, "a", "en", None, 3), (7, "", "en", "s", None), (7, "", "en", "s", None),
        (7, "x", "en", "s", 5), (-3, "é 日本\n", "", "s:-", 0), (1, "word " * 50_000, "en", "-", 2**63 - 1),
        (5, "same", "de", "s", 4), (5, "same", "de", "s", 4), (12, "1:1", None, "", 2),
    ]
    rows += [(i, "t", "en", "s", 1) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = df.withColumns({"leaf": F.lit(1), "POS": F.lit("x"), "grp": F.lit(2), "node": F.lit("n"), "path": F.lit(0)})
    check(extra)
    assert M.report(df.limit(0)).collect() == []


def test_hot_id(spark):
    """One id on most rows: places are dealt by a salt."""
    rows = [(1 if i % 10 else i, f"t{i % 50}", "en", "s", i % 3) for i in range(900)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(6))


def test_documents_of_the_test_data(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet"))


def test_blocks_are_joined_one_to_one(spark):
    """No exchange of the plan carries a row for each document further than its block."""
    rows = [(i, "t", "en", "s", 1) for i in range(600)]
    plan = M.report(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.replace("full", "")
