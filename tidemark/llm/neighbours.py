"""Approximate nearest neighbours by cosine with a hash-prefix forest.

Each of ``trees`` trees gives a vector a long hash string: level after level, the symbol of
the largest coordinate, with its sign, of a random projection.  A tree is the sorted array
of the strings of all vectors, cut into cells by the first symbol and, where a cell would be
large, by a hash of the id.

A query descends in every tree to the entries that share its longest prefix, counted in bits
of the string: binary search in a cell's sorted array counts, for each number of bits, the
entries that share as many.  The counts of all trees and cells, added up, say how far the
query ascends: the same number of bits in all trees, the most at which ``candidates`` entries
are found; the root, which holds all vectors, if none is, or if that is no more work.  A
second pass over the cells scores the entries under that prefix.

How many candidates are enough follows from the table: a bounded set of queries is answered
by brute force, and the least number at which their neighbours share the prefixes that the
queries stop at, up to a recall of ``RECALL``, is taken (``CANDIDATES`` at least).  On a table
with no such number every query goes to the root.

Scores are taken in the cells on the vectors as given, in double precision, so the best of a
cell are the best of it however close they are; the best of all cells are the result.  Only
what a query's prefixes do not hold can be missed.  Of equal vectors only the few with the
least ids can be results, so the others are not entries.

Cases: a vector that is null, zero, or holds null or non-finite components takes no part,
nor does one with a null id or of another length than most; rows of one id count once, the
least vector of it; ties go to the smaller id; a query with fewer candidates returns them
all; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.grouping import runs_of
from tidemark.session import materialize

TREES = 22
LEVELS = 10
#: Coordinates of a level's projection; a level has twice as many symbols.
PROJECTED = 16
#: Bits of a symbol.
SYMBOL_BITS = (2 * PROJECTED - 1).bit_length()
#: Entries, over all trees, at which a query stops ascending at the earliest.
CANDIDATES = 4000
#: Recall that the candidates have to reach for so many queries, answered by brute force.
RECALL = 0.97
PROBED = 200
NEAREST = 5
#: More than sums of products of unit vectors differ by the order of their terms.
ROUNDING = 1e-12
#: Products of vectors that a step works on.
PRODUCTS = 1 << 20
CELL_ROWS = 2048
ROOT = -1
CELL = ["tree", "symbol", "cell"]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector) of the rows that take part, one for each id."""
    v = F.col(vector_col).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where(
        "id is not null and vector is not null and size(vector) > 0"
    )
    rows = rows.where(F.coalesce(whole & some, F.lit(False)))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = sizes["size"] if sizes else 0
    return rows.where(F.size("vector") == size).groupBy("id").agg(F.min("vector").alias("vector"))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither vanish nor overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def hash_strings(units: np.ndarray, trees: int, levels: int) -> np.ndarray:
    """For each tree and vector the string, as a whole number whose high digits are first."""
    out = np.zeros((trees, len(units)), np.int64)
    units = units.astype(np.float32)
    for tree in range(trees):
        random = np.random.Generator(np.random.PCG64([17, tree]))
        for _ in range(levels):
            projected = units @ random.standard_normal((units.shape[1], PROJECTED)).astype(np.float32)
            largest = np.abs(projected).argmax(axis=1)
            positive = projected[np.arange(len(units)), largest] > 0
            out[tree] = out[tree] * (2 * PROJECTED) + largest * 2 + positive
    return out


def entries(vectors: DataFrame, trees: int, levels: int, packed_as: str | None) -> DataFrame:
    """A row per tree and vector: tree, first symbol, string, id and, on wish, the vector in that type."""
    first = (2 * PROJECTED) ** (levels - 1)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                given = matrix(part.column("vector"))
                units = unit(given)
                strings = hash_strings(units, trees, levels)
                packed = [v.tobytes() for v in given.astype(packed_as)] if packed_as else [b""] * len(units)
                for tree in range(trees):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(units), tree, np.int32)),
                            pa.array((strings[tree] // first).astype(np.int32)),
                            pa.array(strings[tree]),
                            part.column("id"),
                            pa.array(packed, pa.binary()),
                        ],
                        ["tree", "symbol", "string", "id", "packed"],
                    )

    return vectors.select("id", "vector").mapInArrow(
        step, "tree int, symbol int, string long, id long, packed binary"
    )


def _ranges(strings: np.ndarray, wanted: np.ndarray, shared: np.ndarray, levels: int, symbols: int = 2 * PROJECTED):
    """Range of the sorted strings that share the given number of symbols with the wanted."""
    width = symbols ** (levels - shared.astype(np.int64))
    low = wanted // width * width
    return np.searchsorted(strings, low), np.searchsorted(strings, low + width)


def _stops(levels: int) -> list[int]:
    """Numbers of shared bits that a query can stop at; a cell holds all entries of a first symbol."""
    return list(range(SYMBOL_BITS, levels * SYMBOL_BITS + 1))


def _descend(levels: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stops = _stops(levels)
        for cell in runs_of(batches, CELL):
            asked = cell.column("level").to_numpy() >= 0
            strings = cell.column("string").to_numpy()
            held, wanted = np.sort(strings[~asked]), strings[asked]
            counts = []
            for bits in stops:
                low, high = _ranges(held, wanted, np.full(len(wanted), bits), levels * SYMBOL_BITS, 2)
                counts.append(high - low)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.column("id").to_numpy()[asked]), *[pa.array(c.astype(np.int64)) for c in counts]],
                ["query", *[f"n{bits}" for bits in stops]],
            )

    return step


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of pairs of rows, the same whatever other rows there are."""
    return np.einsum("ij,ij->i", a, b) if len(a) else np.empty(0)


def best_of(
    units: np.ndarray, ids: np.ndarray, asked: np.ndarray, asked_ids: np.ndarray, nearest: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``asked``, row of ``units`` and score of the nearest of every row of ``asked``."""
    out = []
    size = max(1, PRODUCTS // max(len(units), 1))
    for start in range(0, len(asked), size):
        part, own = asked[start : start + size], asked_ids[start : start + size]
        near = part @ units.T
        near[own[:, None] == ids] = -np.inf
        least = np.full((len(part), 1), -np.inf)
        if len(units) > nearest:
            least = np.partition(near, -nearest, axis=1)[:, -nearest, None] - ROUNDING
        q, u = np.nonzero((near >= least) & (near > -np.inf))
        step = max(1, PRODUCTS // units.shape[1])
        scores = [_dots(units[u[i : i + step]], part[q[i : i + step]]) for i in range(0, len(q), step)]
        scores = np.concatenate(scores) if scores else np.empty(0)
        order = np.lexsort((ids[u], -scores, q))
        q, u, scores = q[order], u[order], scores[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < nearest
        out.append((q[kept] + start, u[kept], scores[kept]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _ascend(levels: int, nearest: int, packed_as: str):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs_of(batches, CELL):
            level, ids = cell.column("level").to_numpy(), cell.column("id").to_numpy()
            asked = level >= 0
            if not asked.any() or asked.all():
                continue
            strings = cell.column("string").to_numpy()
            packed = cell.column("packed").combine_chunks()
            units = unit(np.frombuffer(b"".join(packed.to_pylist()), packed_as).reshape(len(ids), -1).astype(np.float64))
            order = np.flatnonzero(~asked)
            order = order[np.argsort(strings[order], kind="stable")]
            held_ids, held = ids[order], units[order]
            queries = np.flatnonzero(asked)
            low, high = _ranges(strings[order], strings[queries], level[queries], levels * SYMBOL_BITS, 2)
            if cell.column("tree")[0].as_py() == ROOT:
                low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(order))
            spans, span = np.unique(np.stack([low, high]), axis=1, return_inverse=True)
            for k, (a, b) in enumerate(spans.T.tolist()):
                own = queries[span.ravel() == k]
                q, u, scores = best_of(held[a:b], held_ids[a:b], units[own], ids[own], nearest)
                if len(q):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[own][q]), pa.array(held_ids[a:b][u]), pa.array(scores)], ["query", "id", "score"]
                    )

    return step


def _probed(kept: DataFrame, queries: DataFrame, trees: int, levels: int, nearest: int) -> dict[int, list[int]]:
    """For a bounded set of queries, the most bits that each true neighbour shares in a tree."""
    probes = queries.orderBy(F.xxhash64("id"), "id").limit(PROBED).collect()
    if not probes:
        return {}
    asked_ids = np.array([r["id"] for r in probes])
    asked = unit(np.array([r["vector"] for r in probes], np.float64))
    sent = kept.sparkSession.sparkContext.broadcast((asked_ids, asked))  # at most PROBED vectors

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, units = batch.column("id").to_numpy(), unit(matrix(batch.column("vector")))
            q, u, scores = best_of(units, ids, own, own_ids, nearest)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own_ids[q]), pa.array(ids[u]), pa.array(scores)], ["query", "id", "score"]
            )

    found = kept.select("id", "vector").mapInArrow(step, "query long, id long, score double")
    true = _ranked(found, nearest).select(F.col("query_id").alias("query"), F.col("vec_id").alias("id"))
    pairs = true.join(kept, "id").collect()  # at most PROBED x nearest
    own = dict(zip(asked_ids.tolist(), hash_strings(asked, trees, levels).T))
    out: dict[int, list[int]] = {q: [] for q in own}
    if pairs:
        strings = hash_strings(unit(np.array([r["vector"] for r in pairs], np.float64)), trees, levels).T
        for row, string in zip(pairs, strings):
            least = int((string ^ own[row["query"]]).min())
            out[row["query"]].append(levels * SYMBOL_BITS - least.bit_length())
    return out


def enough(counts: dict[int, list[int]], shared: dict[int, list[int]], levels: int, recall: float = RECALL) -> int:
    """The least number of candidates at which the probed queries reach the recall, beyond all counts if none does."""
    stops = _stops(levels)

    def reached(candidates: int) -> float:
        hit = total = 0
        for query, bits in shared.items():
            stop = max((s for s, n in zip(stops, counts.get(query, [])) if n >= candidates), default=0)
            hit += sum(b >= stop for b in bits)
            total += len(bits)
        return hit / max(total, 1)

    tried = sorted({n for c in counts.values() for n in c} | {0})
    low, high = 0, len(tried)
    while low < high:  # more candidates never lower the recall
        middle = (low + high) // 2
        if reached(tried[middle]) >= recall:
            high = middle
        else:
            low = middle + 1
    return tried[low] if low < len(tried) and shared else tried[-1] + 1


def search(
    vectors: DataFrame,
    is_query: Column | str,
    trees: int = TREES,
    levels: int = LEVELS,
    candidates: int | None = None,
    nearest: int = NEAREST,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of every query, a condition on ``id``.

    ``candidates`` follows from the table unless given.
    """
    single = vectors.schema[vector_col].dataType.elementType.typeName() == "float"
    packed_as = "<f4" if single else "<f8"  # either holds the vectors as given
    used = materialize(usable(vectors, id_col, vector_col), "vectors")
    queries = used.where(is_query)
    # Of equal vectors, as many as can be results and the query itself.
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    kept = materialize(used.withColumn("place", place).where(F.col("place") <= nearest + 1).drop("place"), "kept")

    sizes = entries(kept, trees, levels, None).groupBy("tree", "symbol").count()
    # A row per tree and first symbol: at most trees x 2 PROJECTED.
    cells = materialize(sizes.select("tree", "symbol", F.ceil(F.col("count") / F.lit(CELL_ROWS)).alias("cells")), "cells")

    def dealt(packed: str | None, asked: DataFrame) -> DataFrame:
        held = entries(kept, trees, levels, packed).join(F.broadcast(cells), ["tree", "symbol"])
        held = held.withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells"))).withColumn("level", F.lit(-1))
        asked = entries(asked, trees, levels, packed).join(F.broadcast(cells), ["tree", "symbol"])
        return held.drop("cells"), asked.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))

    names = [*CELL, "string", "id", "packed", "level"]
    held, asked = dealt(None, queries)
    asked = asked.withColumn("level", F.lit(0))
    counts = held.select(names).union(asked.select(names)).repartition(*CELL).sortWithinPartitions(*CELL)
    columns = {bits: f"n{bits}" for bits in _stops(levels)}
    counts = counts.mapInArrow(_descend(levels), ", ".join(["query long", *[f"{c} long" for c in columns.values()]]))
    # The query is one of its own candidates in every tree.
    counts = counts.groupBy("query").agg(*[(F.sum(c) - trees).alias(c) for c in columns.values()])
    counts = materialize(counts, "counts")
    rows = kept.count()
    if candidates is None:
        shared = _probed(kept, queries, trees, levels, nearest)
        probed = counts.where(F.col("query").isin(list(shared))).collect() if shared else []
        candidates = max(CANDIDATES, enough({r["query"]: list(r)[1:] for r in probed}, shared, levels))
    # Entries of more than all vectors are no less work than the vectors themselves.
    reached = F.greatest(
        *[F.when(F.col(c).between(candidates, rows), bits).otherwise(0) for bits, c in columns.items()]
    )
    stops = counts.select("query", reached.alias("stop"))
    stops = materialize(
        queries.select(F.col("id").alias("query")).join(stops, "query", "left").select(
            "query", F.coalesce("stop", F.lit(0)).alias("stop")
        ),
        "stops",
    )

    at_root = materialize(queries.join(stops.where("stop = 0"), queries.id == stops.query).select("id", "vector"), "root")
    below = None
    if not stops.where("stop > 0").isEmpty():
        held, asked = dealt(packed_as, queries)
        asked = asked.join(stops.where("stop > 0"), asked.id == stops.query).withColumn("level", F.col("stop"))
        below = held.select(names).union(asked.select(names))
    if below is None or not at_root.isEmpty():
        shards = max(1, -(-rows // CELL_ROWS))
        whole = entries(kept, 1, 1, packed_as).select(
            F.lit(ROOT).alias("tree"), F.lit(0).alias("symbol"), F.pmod(F.xxhash64("id"), F.lit(shards)).alias("cell"),
            F.lit(0).cast("long").alias("string"), "id", "packed", F.lit(-1).alias("level"),
        )
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("cell")
        asked = entries(at_root, 1, 1, packed_as).select(
            F.lit(ROOT).alias("tree"), F.lit(0).alias("symbol"), every,
            F.lit(0).cast("long").alias("string"), "id", "packed", F.lit(0).alias("level"),
        )
        at_all = whole.select(names).union(asked.select(names))
        below = at_all if below is None else below.union(at_all)
    found = below.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(
        _ascend(levels, nearest, packed_as), "query long, id long, score double"
    )
    return _ranked(found, nearest)


def _ranked(found: DataFrame, nearest: int) -> DataFrame:
    """The nearest of every query, of pairs that several trees may have found."""
    pairs = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= nearest).select(
        F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score"
    )
