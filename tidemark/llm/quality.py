"""Quality classifier: random-indexing word vectors, a small network, calibrated scores.

Words and runs of marks fall into a fixed number of hash buckets.  A bucket's random index
vector is sparse and follows from its number; its word vector is the sum of the index
vectors of the words around its occurrences, over all documents.  A document is pooled to
the mean vector of its words, the mean vector of its distinct words, and how long and how
repetitive it is.  A network of two layers is trained on pooled documents, and a temperature
found on rows kept from training makes its outputs probabilities.

The word vectors come from one scan whose tasks add up ``buckets`` vectors each; the sums
are whole numbers, so they do not depend on the order of tasks.  The table, buckets x
dimensions, has a fixed size and is sent to every task.  The network is fitted on the driver
from at most ``train_rows`` labelled rows, a documented bound.

Cases: a null or empty text is pooled to zeros and scored like any other; without labels of
both kinds every score is the share of label 1, smoothed; several labels of a document are
averaged, a null label or label id is no label; repeated rows are scored each; a long text
is pooled whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import mark_hashes, steps, text_buffer

BUCKETS = 1 << 14
DIMENSIONS = 32
NONZERO = 4
REACH = 2
#: Labelled rows that the network is fitted on, at most.
TRAIN_ROWS = 10_000
HIDDEN = 24
EPOCHS = 60
#: A document is called good from this score on.
GOOD = 0.3


def index_vectors(buckets: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of every bucket's index vector."""
    random = np.random.Generator(np.random.PCG64(11))
    places = np.argsort(random.random((buckets, dimensions)), axis=1)[:, :NONZERO]
    return places, random.choice([-1.0, 1.0], (buckets, NONZERO))


def marks(batch: pa.RecordBatch, buckets: int, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word or mark of the batch, and the first of each row."""
    hashes, firsts = mark_hashes(*text_buffer(batch.column(text_col)))
    return (hashes % np.uint64(buckets)).astype(np.int64), firsts


def word_vectors(docs: DataFrame, buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit-length vector of every bucket from the contexts of its words in all texts."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors(buckets, dimensions)
        total = np.zeros(buckets * dimensions)
        for batch in steps(batches, "text"):
            words, firsts = marks(batch, buckets)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(firsts))
            for distance in range(1, REACH + 1):
                near = np.flatnonzero(rows[distance:] == rows[:-distance])
                for one, other in ((near, near + distance), (near + distance, near)):
                    base, context = words[one] * dimensions, words[other]
                    for k in range(NONZERO):
                        total += np.bincount(base + places[context, k], signs[context, k], len(total))
        table = total.astype(np.int64).reshape(buckets, dimensions)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), *[pa.array(table[used, d]) for d in range(dimensions)]],
            ["bucket", *[f"v{d}" for d in range(dimensions)]],
        )

    names = [f"v{d}" for d in range(dimensions)]
    parts = docs.select("text").mapInArrow(step, ", ".join(["bucket long", *[f"{n} long" for n in names]]))
    # At most ``buckets`` rows reach the driver, whatever the input.
    sums = parts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    table = np.zeros((buckets, dimensions))
    if sums.num_rows:
        table[sums["bucket"].to_numpy()] = np.stack([sums[n].to_numpy() for n in names], axis=1)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(batch: pa.RecordBatch, vectors: np.ndarray) -> np.ndarray:
    """One row of features per text."""
    words, firsts = marks(batch, len(vectors))
    counts = np.diff(firsts)
    n, dimensions = batch.num_rows, vectors.shape[1]
    rows = np.repeat(np.arange(n), counts)
    pairs = np.unique(rows * len(vectors) + words)
    kinds = np.bincount(pairs // len(vectors), minlength=n)

    def means(of: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.zeros((n, dimensions), np.float32)
        full = np.flatnonzero(sizes)
        if len(full):
            starts = np.append(0, np.cumsum(sizes))[full]
            out[full] = np.add.reduceat(vectors[of], starts, axis=0, dtype=np.float64) / sizes[full, None]
        return out

    shape = np.stack([np.log1p(counts), kinds / np.maximum(counts, 1)], axis=1)
    return np.hstack([means(words, counts), means(pairs % len(vectors), kinds), shape]).astype(np.float64)


# ---------------------------------------------------------------- network


@dataclass
class Network:
    """Two layers, the scaling of their inputs and a temperature; or a constant share."""

    share: float
    weights: tuple[np.ndarray, ...] | None = None
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh((features - self.center) / self.scale @ a + b) @ c + d

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -500, 500)))


def fit(features: np.ndarray, labels: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS) -> Network:
    """Train with Adam on four fifths of the rows; the temperature comes from the rest."""
    share = float((labels.sum() + 1) / (len(labels) + 2))
    if len(np.unique(labels)) < 2:
        return Network(share)
    random = np.random.Generator(np.random.PCG64(3))
    order = random.permutation(len(labels))
    kept, used = order[: len(order) // 5], order[len(order) // 5 :]
    center, scale = features[used].mean(axis=0), features[used].std(axis=0) + 1e-6
    inputs = (features - center) / scale
    size = inputs.shape[1]
    weights = [random.normal(0, size**-0.5, (size, hidden)), np.zeros(hidden), random.normal(0, hidden**-0.5, hidden), 0.0]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    tick = 0
    for _ in range(epochs):
        used = random.permutation(used)
        for first in range(0, len(used), 256):
            part = used[first : first + 256]
            x, y = inputs[part], labels[part]
            inner = np.tanh(x @ weights[0] + weights[1])
            error = 1 / (1 + np.exp(-np.clip(inner @ weights[2] + weights[3], -30, 30))) - y
            back = np.outer(error, weights[2]) * (1 - inner**2)
            slopes = [x.T @ back / len(y) + 1e-4 * weights[0], back.mean(axis=0), inner.T @ error / len(y), error.mean()]
            tick += 1
            for k, slope in enumerate(slopes):
                m, v = moments[k]
                moments[k] = [0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * np.square(slope)]
                m, v = moments[k][0] / (1 - 0.9**tick), moments[k][1] / (1 - 0.999**tick)
                weights[k] = weights[k] - 0.01 * m / (np.sqrt(v) + 1e-8)
    found = Network(share, tuple(weights), center, scale)
    found.temperature = temperature(found.logits(features[kept]), labels[kept])
    return found


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits under which the labels are likeliest."""
    tried = np.geomspace(0.1, 20, 200)
    sign = np.where(labels == 1, 1, -1)
    loss = [np.logaddexp(0, -sign * logits / t).sum() for t in tried]
    return float(tried[int(np.argmin(loss))]) if len(labels) else 1.0


# ---------------------------------------------------------------- jobs


def held_out(id_col: str = "doc_id") -> Column:
    """The fifth of documents whose labels are never used; a null id is not in it."""
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))
    return F.coalesce(fold == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, train_rows: int = TRAIN_ROWS) -> Network:
    """Fit the network to labelled texts outside the held-out fold.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and ``quality``.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    share = min(1.0, train_rows / max(known.count(), 1))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # About ``train_rows`` rows of two numbers: a bounded table, sent to every task.
    drawn = F.broadcast(known.where(draw < int(share * (1 << 30))))
    schema = "doc_id long, label int, features array<double>"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            features = pooled(batch, table.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(list(features), pa.list_(pa.float64()))],
                ["doc_id", "label", "features"],
            )

    table = docs.sparkSession.sparkContext.broadcast(vectors)
    # Rows of one id are one, with the least text.
    texts = docs.select("doc_id", "text").join(drawn, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = texts.mapInArrow(step, schema).toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return Network(0.5)
    return fit(np.array(rows["features"].to_pylist()), rows["label"].to_numpy().astype(np.float64))


def score(docs: DataFrame, vectors: np.ndarray, network: Network, good: float = GOOD) -> DataFrame:
    """``docs`` without the text, with ``score`` and ``predicted``."""
    sent = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, model = sent.value
        for batch in steps(batches, "text"):
            scores = model.scores(pooled(batch, table))
            kept = [i for i, c in enumerate(batch.schema.names) if c not in ("text", "score", "predicted")]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in kept],
                    pa.array(scores, pa.float64()),
                    pa.array((scores >= good).astype(np.int32)),
                ],
                [*[batch.schema.names[i] for i in kept], "score", "predicted"],
            )

    shape = docs.drop("text", "score", "predicted").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    return docs.mapInArrow(step, shape.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Word vectors from all texts, the network from the labelled ones, a score for each."""
    texts = docs.select("doc_id", "text")
    vectors = word_vectors(texts)
    network = train(texts, labels, vectors)
    return score(texts.select("doc_id", held_out().alias("held_out"), "text"), vectors, network)
