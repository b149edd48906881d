import math

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import neighbours as N

FIFTIETH = "pmod(id, 50) = 0"
SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, is_query, nearest=5):
    used = {}
    for key, v in rows:
        if key is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        used[key] = min(used.get(key, v), v)
    ids = np.array(sorted(used))
    if not len(ids):
        return {}
    x = np.array([used[i] for i in ids], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, key in enumerate(ids.tolist()):
        if is_query(key):
            scores = x @ x[i]
            best = [j for j in np.lexsort((ids, -scores.round(12))) if j != i][:nearest]
            out[key] = [(int(ids[j]), float(scores[j])) for j in best]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def test_recall_on_the_test_data(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [tuple(r) for r in vectors.collect()]
    got, want = found(N.search(vectors, FIFTIETH)), brute(rows, lambda i: i % 50 == 0)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert recall(got, want) >= 0.9
    scores = dict(rows)
    for q, found_ in got.items():
        for i, s in found_:
            a, b = np.array(scores[q], float), np.array(scores[i], float)
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_forest_without_the_root(spark, monkeypatch):
    """Few candidates are enough, so every query stops above the root, and cells are split."""
    monkeypatch.setattr(N, "CELL_ROWS", 64)
    r = np.random.default_rng(1)
    centers = r.normal(size=(40, 24))
    rows = [(i, [float(x) for x in centers[i % 40] + 0.15 * r.normal(size=24)]) for i in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(N.search(df, FIFTIETH, candidates=60))
    stored = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert recall(got, brute(stored, lambda i: i % 50 == 0)) >= 0.9


def test_ranges_at_every_level():
    r = np.random.default_rng(5)
    strings = np.sort(r.integers(0, 32**10, 5000))
    wanted = strings[::50] ^ 3
    for shared in range(0, 11):
        width = 32 ** (10 - shared)
        low, high = N._ranges(strings, wanted, np.full(len(wanted), shared, np.int32), 10)
        same = [int((strings // width == w // width).sum()) for w in wanted]
        assert (high - low).tolist() == same


def test_odd_vectors_and_ties(spark):
    v = [1.0, 2.0, 0.0]
    rows = [(0, v), (50, [2.0, 4.0, 0.0]), (3, v), (2, v), (1, v), (4, v), (5, v), (6, v), (7, v), (8, [0.0, 0.0, 1.0]),
            (9, None), (10, [0.0, 0.0, 0.0]), (11, [1.0, None, 2.0]), (12, [1.0, float("nan"), 0.0]), (None, v), (13, []),
            (14, [float("inf"), 1.0, 1.0]), (15, [1.0, 2.0]), (3, v), (100, [-1.0, 0.0, 0.0]), (100, [0.0, -1.0, 0.0])]
    df = spark.createDataFrame([(*x, 0, "r") for x in rows], SCHEMA + ", id int, rank string")
    got = found(N.search(df, FIFTIETH))
    want = brute([x for x in rows if x[0] != 15], lambda i: i % 50 == 0)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 0.0])], [(0, [1.0, 0.0]), (1, [0.0, 1e-30])]])
def test_few_rows(spark, rows):
    got = found(N.search(spark.createDataFrame(rows, SCHEMA), FIFTIETH))
    assert {q: len(x) for q, x in got.items()} == ({0: len(rows) - 1} if len(rows) > 1 else {})


def test_close_vectors_of_a_tight_group(spark):
    """Distinct vectors whose cosines differ by far less than half precision tells."""
    r = np.random.default_rng(7)
    center = r.normal(size=64)
    x = np.concatenate([center + 2e-4 * r.normal(size=(2000, 64)), r.normal(size=(3000, 64))]).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got = found(N.search(spark.createDataFrame(rows, SCHEMA), FIFTIETH))
    want = brute(rows, lambda i: i % 50 == 0)
    of_group = {q: w for q, w in want.items() if q < 2000}
    assert recall(got, of_group) >= 0.99 and recall(got, want) >= 0.9


def test_recall_on_many_vectors(spark):
    """The candidates follow from the table; a fixed number loses neighbours here."""
    given = np.array([r[0] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").collect()])
    r = np.random.default_rng(8)
    x = r.multivariate_normal(given.mean(axis=0), np.cov(given.T), 200_000, method="cholesky").astype(np.float32)
    table = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float32()))})
    got = found(N.search(spark.createDataFrame(table).repartition(16), "pmod(id, 2000) = 0"))
    units = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = {}
    for q in range(0, len(x), 2000):
        scores = units @ units[q]
        scores[q] = -1
        want[q] = [(int(i), scores[i]) for i in np.argsort(-scores)[:5]]
    assert got.keys() == want.keys() and recall(got, want) >= 0.93
