"""Similarity join of documents on word n-grams: MinHash banding, exact verification.

Documents with the same set of n-grams form a class, kept as one representative with the
number of its copies.  Representatives that agree in a band of their MinHash signature meet
in a bucket; there the Jaccard similarity of their full n-gram sets decides.  The rows of
a band and the number of bands follow from the similarity and the wanted recall.

A bucket is cut into tiles of bounded members and n-grams, so no group is ever in one task,
and a tile returns a row per member: how many documents it is linked to and the least member that its
links lead to.  Pairs are counted in matrices and never written.  A pair that agrees in
several bands is counted in the first of them.  The groups that links connect come from
rounds of contraction on those rows.

Cases: a text of fewer words than an n-gram, but not none, has one n-gram of all its words;
a null text or one without words has no n-gram, is linked to nothing and is its own group;
repeated rows are copies; a group without any document id has a null id; a long text
counts whole; other columns are not read by the join and kept by the filter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.grouping import runs_of
from tidemark.llm.tokens import gram_hashes, mixed, steps, text_buffer, word_hashes
from tidemark.session import materialize

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9995
MOST_BANDS = 16
#: Members of a bucket that one tile compares with as many others, and their n-grams.
TILE = 384
TILE_GRAMS = 400_000
#: Grams that are compared at a time inside a tile.
GRAM_BLOCK = 4096
TILE_KEYS = ["band", "value", "left", "right"]


def bands_for(similarity: float, recall: float, most: int = MOST_BANDS) -> tuple[int, int]:
    """Bands and rows: the most selective rows whose bands for the recall are at most ``most``."""
    best = None
    for rows in range(1, 33):
        p = similarity**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands <= most or best is None:
            best = (bands, rows)
    return best


def distinct_grams(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Every row's distinct n-grams as (gram, row), sorted by row, then gram."""
    grams, rows = gram_hashes(*word_hashes(data, offsets), words)
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    return grams[new], rows[new]


def signatures(docs: DataFrame, words: int, bands: int, rows: int, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with the class of the n-gram set, its size and the band hashes.

    The class is null and the bands are empty where there is no n-gram.
    """
    random = np.random.Generator(np.random.PCG64(5))
    flips = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    factors = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_col):
            grams, of = distinct_grams(*text_buffer(batch.column(text_col)), words)
            n = batch.num_rows
            present, starts = np.unique(of, return_index=True)
            classes = np.full(n, None, object)
            hashes = np.zeros((n, bands), np.uint64)
            if len(present):
                low = np.add.reduceat(mixed(grams), starts)
                high = np.add.reduceat(mixed(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                pairs = np.stack([low, high], axis=1)
                classes[present] = [p.tobytes() for p in pairs]
                for band in range(bands):
                    total = np.full(len(present), band, np.uint64)
                    for k in range(band * rows, band * rows + rows):
                        total = mixed(total + np.minimum.reduceat((grams ^ flips[k]) * factors[k], starts))
                    hashes[present, band] = total
            kept = [i for i, c in enumerate(batch.schema.names) if c != text_col]
            with_grams = np.isin(np.arange(n), present)
            lists = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(with_grams * bands)), pa.int32()),
                pa.array(hashes[with_grams].view(np.int64).ravel()),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in kept],
                    pa.array(classes, pa.binary()),
                    pa.array(np.bincount(of, minlength=n), pa.int64()),
                    lists,
                ],
                [*[batch.schema.names[i] for i in kept], "class", "grams", "bands"],
            )

    shape = docs.drop(text_col).withColumns(
        {
            "class": F.lit(None).cast("binary"),
            "grams": F.lit(0).cast("long"),
            "bands": F.array().cast("array<long>"),
        }
    )
    return docs.mapInArrow(step, shape.schema)


# ---------------------------------------------------------------- verification


def overlaps(grams: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """How many grams each two of the ``n`` sets share."""
    shared = np.zeros((n, n), np.float32)
    names, column, counts = np.unique(grams, return_inverse=True, return_counts=True)
    common = counts > 1
    number = np.cumsum(common) - 1
    use = common[column]
    rows, columns = of[use], number[column[use]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for first in range(0, int(common.sum()), GRAM_BLOCK):
        a, b = np.searchsorted(columns, [first, first + GRAM_BLOCK])
        block = np.zeros((n, min(GRAM_BLOCK, int(common.sum()) - first)), np.float32)
        block[rows[a:b], columns[a:b] - first] = 1
        shared += block @ block.T
    return shared


def tile_links(texts: pa.Array, bands: np.ndarray, band: int, part: np.ndarray, words: int, similarity: float):
    """Pairs of a tile that are similar and agree in no earlier band, as a matrix.

    ``part`` says on which side of the tile a member stands: 0 and 1 are compared with each
    other, 2 is a tile of one block compared with itself.
    """
    n = len(part)
    wanted = part[:, None] != part[None, :] if (part < 2).any() else ~np.eye(n, dtype=bool)
    for earlier in range(band):
        wanted &= bands[:, None, earlier] != bands[None, :, earlier]
    if not wanted.any():
        return wanted
    grams, of = distinct_grams(*text_buffer(texts), words)
    sizes = np.bincount(of, minlength=n).astype(np.float64)
    shared = overlaps(grams, of, n).astype(np.float64)
    # In whole numbers of grams: shared / union >= similarity.
    return wanted & (shared >= similarity * (sizes[:, None] + sizes[None, :] - shared) - 1e-9) & (shared > 0)


def least_reached(linked: np.ndarray) -> np.ndarray:
    """For every member the least member that links lead to."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(linked)).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tile_step(words: int, similarity: float):
    def tile(batch: pa.Table):
        batch = batch.sort_by("class")
        classes = batch.column("class").to_pylist()
        bands = np.array(batch.column("bands").to_pylist(), np.int64)
        left, right = batch.column("left")[0].as_py(), batch.column("right")[0].as_py()
        block = batch.column("block").to_numpy()
        part = np.full(len(classes), 2) if left == right else (block == right).astype(int)
        texts = batch.column("text").combine_chunks()
        linked = tile_links(texts, bands, batch.column("band")[0].as_py(), part, words, similarity)
        found = np.flatnonzero(linked.any(axis=1))
        degree = linked @ batch.column("copies").to_numpy()
        label = least_reached(linked)
        return [(classes[i], int(degree[i]), classes[label[i]]) for i in found]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, TILE_KEYS):
            rows = tile(group)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.binary()))],
                ["class", "links", "least"],
            )

    return step


def text_key(text_col: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text_col), F.lit("")))


def links(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
) -> tuple[DataFrame, DataFrame]:
    """The written signatures of all rows, and per class its copies, links and group.

    Signatures: ``doc_id``, ``key`` (of the text), ``class``.  Classes: ``class``, ``copies``,
    ``rep`` (least id and key), ``links`` (documents linked to each member of the class) and
    ``group`` (the least class that links lead to).
    """
    bands, rows = bands_for(similarity, recall)
    texts = docs.select(
        F.col(id_col).alias("doc_id"), text_key(text_col).alias("key"), F.col(text_col).alias("text")
    )
    signed = materialize(signatures(texts, words, bands, rows), "signatures")
    # Null ids come last.
    rep = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    classes = materialize(
        signed.where(F.col("class").isNotNull())
        .groupBy("class")
        .agg(
            F.count("*").alias("copies"),
            F.min(rep).alias("rep"),
            F.max("grams").alias("grams"),
            F.max("bands").alias("bands"),
        ),
        "classes",
    )
    slots = classes.select("class", "grams", F.posexplode("bands").alias("band", "value"))
    sizes = slots.groupBy("band", "value").agg(F.count("*").alias("members"), F.sum("grams").alias("weight"))
    buckets = materialize(sizes.where("members > 1"), "buckets")
    blocks = F.ceil(F.greatest(F.col("members") / F.lit(TILE), F.col("weight") / F.lit(TILE_GRAMS))).cast("int")
    block = F.pmod(F.xxhash64("class", "band"), F.col("blocks")).cast("int")
    # A member of block b stands in the tiles of b with every block; once in that of b with b.
    tiles = (
        slots.join(buckets, ["band", "value"])
        .withColumn("blocks", blocks)
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "class", "band", "value", "block",
            F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
        )
    )
    wanted = materialize(tiles, "tiles")
    # The text, bands and copies of every class that has a bucket, once.
    needed = wanted.select("class").distinct().join(classes, "class")
    needed = needed.select("class", "copies", "bands", "rep.doc_id", "rep.key")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key"))
    # Repeated rows of a representative are one.
    content = texts.alias("a").join(needed.alias("b"), same).select("b.class", "b.copies", "b.bands", "a.text")
    sent = wanted.join(content.dropDuplicates(["class"]), "class").repartition(*TILE_KEYS)
    found = materialize(
        sent.sortWithinPartitions(*TILE_KEYS).mapInArrow(
            _tile_step(words, similarity), "class binary, links long, least binary"
        ),
        "found",
    )
    groups = connected(found.where(F.col("class") != F.col("least")).select("class", "least"))
    degree = found.groupBy("class").agg(F.sum("links").alias("linked"))
    joined = classes.drop("bands", "grams").join(degree, "class", "left").join(groups, "class", "left")
    return signed, joined.select(
        "class", "copies", "rep",
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("group", "class").alias("group"),
    )


def connected(edges: DataFrame) -> DataFrame:
    """(class, group): the group of every node of the edges, by rounds of contraction.

    Each round gives every node the least node among itself and its neighbours, which as
    hashes lie in no order, and goes on with the edges between those.
    """
    edges = edges.toDF("a", "b")
    steps_down: list[DataFrame] = []
    while True:
        both = edges.union(edges.select("b", "a")).distinct()
        down = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("down")), "down")
        if down.isEmpty():
            break
        steps_down.append(down)
        to = down.select(F.col("a").alias("node"), F.col("down").alias("to"))
        left = edges.join(to, edges.a == to.node).select(F.col("to").alias("a"), "b")
        right = left.join(to, left.b == to.node).select("a", F.col("to").alias("b"))
        edges = materialize(right.where("a != b").distinct(), "edges")
    if not steps_down:
        return edges.select(F.col("a").alias("class"), F.col("b").alias("group"))
    out = steps_down[0].select(F.col("a").alias("class"), F.col("down").alias("group"))
    for down in steps_down[1:]:
        to = down.select(F.col("a").alias("node"), F.col("down").alias("to"))
        out = out.join(to, out.group == to.node, "left").select("class", F.coalesce("to", "group").alias("group"))
    return materialize(out, "groups")


def classify(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``class_id`` (least document id of its group) and ``n_links``."""
    signed, classes = links(docs, **options)
    ids = classes.groupBy("group").agg(F.min("rep.doc_id").alias("class_id"))
    of_class = materialize(classes.join(ids, "group").select("class", "class_id", "links"), "of-class")
    alone = signed.where(F.col("class").isNull()).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")
    )
    return (
        signed.where(F.col("class").isNotNull())
        .join(of_class, "class")
        .select("doc_id", "class_id", F.col("links").alias("n_links"))
        .union(alone)
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, columns as given, of one document of each group: that with the least id.

    Of several rows with that id and text, the least row stays.  Documents without words
    all stay.
    """
    signed, classes = links(docs, id_col=id_col, text_col=text_col, **options)
    least = classes.groupBy("group").agg(F.min("rep").alias("rep")).select("rep.doc_id", "rep.key")
    rows = signed.where(F.col("class").isNotNull()).groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key"))
    keep = materialize(rows.alias("a").join(least.alias("b"), same).select("a.doc_id", "a.key", "a.n"), "keep")
    alone = signed.where(F.col("class").isNull()).select("doc_id", "key", F.lit(1).alias("n")).distinct()
    keep = keep.union(alone)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(
        F.col(id_col).alias("llm:id"), text_key(text_col).alias("llm:key"), F.struct(*columns).alias("llm:row")
    )
    match = F.col("llm:id").eqNullSafe(F.col("doc_id")) & (F.col("llm:key") == F.col("key"))
    kept = whole.join(keep, match)
    once = kept.where("n = 1").select("llm:row")
    more = kept.where("n > 1").groupBy("llm:id", "llm:key").agg(F.min("llm:row").alias("llm:row")).select("llm:row")
    return once.union(more).select(*[F.col(f"`llm:row`.`{c}`").alias(c) for c in docs.columns])
