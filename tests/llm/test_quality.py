import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import quality as Q


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    good = labels == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.classify(docs, labels)
    rows = got.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").toPandas()
    assert got.count() == docs.count() and len(rows) > 300
    labels_, scores = rows["quality"].to_numpy(), rows["score"].to_numpy()
    assert auc(scores, labels_) > 0.97
    assert ((scores >= Q.GOOD) == (rows["predicted"] == 1)).all()
    assert (rows["predicted"] == labels_).mean() > 0.95
    # Calibrated: the mean score is the share of good ones.
    assert abs(scores.mean() - labels_.mean()) < 0.05


def test_word_vectors_against_a_loop(spark):
    texts = ["the cat, the dog", "a cat!! a", None, "", "cat"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = Q.word_vectors(df, buckets=64, dimensions=8)
    places, signs = Q.index_vectors(64, 8)
    want = np.zeros((64, 8))
    for text in texts:
        words, _ = Q.marks(pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["text"]), 64)
        for i, w in enumerate(words):
            for j in range(max(0, i - Q.REACH), min(len(words), i + Q.REACH + 1)):
                if i != j:
                    np.add.at(want[w], places[words[j]], signs[words[j]])
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(got, want, atol=1e-6)


def test_temperature_and_one_sided_labels():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 3))
    y = (r.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    model = Q.fit(x, y)
    scores = model.scores(x)
    for low in np.arange(0, 1, 0.2):
        part = (scores >= low) & (scores < low + 0.2)
        if part.sum() > 200:
            assert abs(scores[part].mean() - y[part].mean()) < 0.08
    over = Q.temperature(10 * np.log(0.8 / 0.2) * np.where(y == 1, 1, 1), np.append(np.ones(3200), np.zeros(800)))
    assert over > 5
    assert Q.fit(x, np.ones(4000)).scores(x)[0] > 0.99


def test_odd_rows(spark):
    schema = "doc_id long, text string, quality int, score string"
    rows = [(1, None, 0, "a"), (2, "", 0, "a"), (2, "", 0, "a"), (None, "word " * 20000, 1, "b"), (4, "x", None, None)]
    df = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = Q.classify(df, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    empty = Q.classify(df, labels.limit(0)).collect()
    assert {r["score"] for r in empty} == {0.5}
    assert Q.classify(df.limit(0), labels).collect() == []
    assert Q.classify(df, labels).columns == ["doc_id", "held_out", "score", "predicted"]


def test_held_out_labels_are_not_used(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    wrong = labels.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = Q.classify(docs, labels).select("doc_id", "score").collect()
    b = Q.classify(docs, wrong).select("doc_id", "score").collect()
    assert sorted(a) == sorted(b)
