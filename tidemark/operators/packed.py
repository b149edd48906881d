"""Values of many columns in many groups, each moved once.

A task sorts blocks of its rows and packs the distinct (cell, value) pairs of all columns, with the
rows of each, into a compressed blob per bucket of values; a cell is the rows of the same groups.
Numbers are bucketed by range, so buckets have an order, anything else by hash.  The blobs are
written and shuffled by bucket; a bucket is copied to groups where it is looked at, in numpy.  A
row costs a few bytes and a bucket holds about ``BUCKET_ROWS`` rows, whatever the groups are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col
from tidemark.session import materialize

#: Rows that a task packs at a time, and rows of a bucket.
BLOCK_ROWS = 1_000_000
BUCKET_ROWS = 500_000
#: Size of the sketches that buckets are cut by.
CUT_SIZE = 800

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)
_REAL = (T.FloatType, T.DoubleType)
_PACKED = "bucket int, width int, cells array<long>, texts array<string>, blob binary"
_PARTS = "_gid long, _column int, bucket int, rows long, distinct long"
_FOUND = "_gid long, _column int, value double"


def _value(name: str, data_type: T.DataType) -> Column:
    c = col(name)
    if isinstance(data_type, _WHOLE):
        return (F.unix_date(c) if isinstance(data_type, T.DateType) else c).cast("long")
    if isinstance(data_type, _REAL):
        return c.cast("double") + F.lit(0.0)  # one zero
    return F.base64(c) if isinstance(data_type, T.BinaryType) else c.cast("string")


def packed_kinds(rows: DataFrame, columns: Sequence[str], source: Callable[[str], str] = str) -> list[str]:
    """``whole``, ``real`` or ``text`` for each column."""
    types = {f.name: f.dataType for f in rows.schema.fields}
    named = [types[source(c)] for c in columns]
    return ["whole" if isinstance(t, _WHOLE) else "real" if isinstance(t, _REAL) else "text" for t in named]


def _starts(*sorted_: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before."""
    other = np.zeros(max(len(sorted_[0]) - 1, 0), bool)
    for a in sorted_:
        other |= a[1:] != a[:-1]
    return np.flatnonzero(np.r_[True, other])


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row of a matrix, and the different rows in the order of the numbers."""
    codes = np.zeros(len(ids), "int64")
    for j in range(ids.shape[1]):
        here, values = pd.factorize(ids[:, j])
        codes = pd.factorize(codes * len(values) + here)[0]
    firsts = np.unique(codes, return_index=True)[1]
    return codes, ids[firsts]


def _pack(kinds: list[str], cuts: list[list[float]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def blob(arrays: list[np.ndarray]) -> bytes:
        batch = pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["column", "key", "cell", "n"])
        sink, options = pa.BufferOutputStream(), pa.ipc.IpcWriteOptions(compression="zstd")
        with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
            writer.write_batch(batch)
        return sink.getvalue().to_pybytes()

    def pairs(i: int, table: pa.Table, cell: np.ndarray) -> tuple | None:
        """Of a column, by bucket: where each bucket begins, values, and of each pair value, cell, rows."""
        given = table[f"v{i}"].combine_chunks()
        here = np.flatnonzero(given.is_valid().to_numpy(zero_copy_only=False))
        if not len(here):
            return None
        if kinds[i] == "text":
            code, values = pd.factorize(given.to_numpy(zero_copy_only=False)[here])
            bucket = np.zeros(len(values), "int64")
            bucket[code] = table[f"b{i}"].to_numpy()[here]
            order = np.argsort(bucket, kind="stable")
            values, bucket = np.asarray(values, object)[order], bucket[order]
            code = np.argsort(order)[code]
        else:
            values, code = np.unique(given.drop_null().to_numpy(), return_inverse=True)
            bucket = np.searchsorted(cuts[i], values.astype("float64"), "right")
        pair = code * (cell.max() + 1) + cell[here]
        pair.sort()
        at = _starts(pair)
        n = np.diff(np.r_[at, len(pair)]).astype("int32")
        value, of_cell = np.divmod(pair[at], cell.max() + 1)
        return bucket[value], values, value.astype("int32"), of_cell.astype("int32"), n

    def pack(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = table["_gids"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        cell, cells = _numbered(ids)
        found = {i: p for i in range(len(kinds)) if (p := pairs(i, table, cell))}
        for bucket in np.unique(np.concatenate([np.unique(p[0]) for p in found.values()])) if found else []:
            words, sides = [], []
            for i, (of_bucket, values, value, of_cell, n) in found.items():
                a, b = np.searchsorted(of_bucket, [bucket, bucket + 1])
                if a == b:
                    continue
                mine = values[value[a] : value[b - 1] + 1]
                if kinds[i] == "text":
                    keys = value[a:b].astype("int64") - value[a] + len(words)
                    words += mine.tolist()
                else:
                    keys = np.where(np.isnan(mine), np.nan, mine).view("int64") if kinds[i] == "real" else mine
                    keys = keys[value[a:b] - value[a]]
                sides.append((np.full(b - a, i, "int16"), keys, of_cell[a:b], n[a:b]))
            column, key, of_cell, n = (np.concatenate(side) for side in zip(*sides))
            used, mine = np.unique(of_cell, return_inverse=True)
            packed = blob([column, np.diff(key, prepend=0), mine.astype("int32"), n])
            row = (int(bucket), ids.shape[1], cells[used].ravel().tolist(), words, packed)
            types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary()]
            names = [c.split()[0] for c in _PACKED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield from pack(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield from pack(pa.Table.from_batches(held))

    return run


def packed(cells: DataFrame, columns: Sequence[str], source: Callable[[str], str] = str) -> tuple[DataFrame, int]:
    """The written blobs of rows with ``_gids``, and the number of buckets."""
    types = {f.name: f.dataType for f in cells.schema.fields}
    kinds = packed_kinds(cells, columns, source)
    values = [_value(source(c), types[source(c)]).alias(f"v{i}") for i, c in enumerate(columns)]
    rows = cells.select("_gids", *values)
    numbers = [i for i, k in enumerate(kinds) if k != "text"]
    sketches = rows.agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(F.col(f"v{i}").cast("double"), CUT_SIZE).alias(f"k{i}") for i in numbers])
    sketches = materialize(sketches, "cuts")
    buckets = max(1, math.ceil(sketches.first()["n"] / BUCKET_ROWS))
    cuts: list[list[float]] = [[] for _ in columns]
    if buckets > 1 and numbers:
        shares = F.array(*[F.lit(j / buckets) for j in range(1, buckets)])
        found = [F.when(F.kll_sketch_get_n_double(f"k{i}") > 0, F.kll_sketch_get_quantile_double(f"k{i}", shares)) for i in numbers]
        for i, cut in zip(numbers, sketches.select(*found).first()):
            cuts[i] = list(cut or [])
    hashed = [F.pmod(F.xxhash64(f"v{i}"), F.lit(buckets)).cast("int").alias(f"b{i}") for i, k in enumerate(kinds) if k == "text"]
    return materialize(rows.select("*", *hashed).mapInArrow(_pack(kinds, cuts), _PACKED), "packed"), buckets


def _of_groups(table: pa.Table, kinds: list[str], asked: dict[int, np.ndarray] | None = None) -> Iterator[tuple]:
    """Of one bucket, by column: number, group ids, and in order of (group, value): group, value, rows.

    ``asked`` are the groups wanted of each column, if not all are.
    """
    ids, words, columns = [], [], []
    n_cells = n_words = 0
    for row in table.select(["width", "cells", "texts", "blob"]).to_pylist():
        here = np.array(row["cells"], "int64").reshape(-1, row["width"])
        read = pa.ipc.open_stream(row["blob"]).read_all()
        column, key, cell, n = (read[c].to_numpy() for c in ("column", "key", "cell", "n"))
        is_text = np.array([k == "text" for k in kinds])[column]
        columns.append((column, np.cumsum(key) + n_words * is_text, cell + n_cells, n))
        ids.append(here)
        words += row["texts"]
        n_cells, n_words = n_cells + len(here), n_words + len(row["texts"])
    codes, gids = pd.factorize(np.concatenate(ids).ravel())
    codes = codes.reshape(n_cells, -1)
    column, key, cell, n = (np.concatenate(side) for side in zip(*columns))
    order = np.argsort(column, kind="stable")
    at = _starts(column[order])
    texts = np.array(words, object)
    for i, rows in zip(column[order][at], np.split(order, at[1:])):
        if asked is not None and int(i) not in asked:
            continue
        of = codes[cell[rows]]
        if asked is not None:
            wanted = np.isin(gids, asked[int(i)])
            near = wanted[of].any(axis=1)
            rows, of = rows[near], of[near]
        if kinds[i] == "text":
            rank, values = pd.factorize(texts[key[rows]])
        else:
            values, rank = np.unique(key[rows].view("float64") if kinds[i] == "real" else key[rows], return_inverse=True)
        pair = (of * len(values) + rank[:, None]).ravel()
        weight = np.repeat(n[rows].astype("int64"), of.shape[1])
        if asked is not None:
            near = wanted[of].ravel()
            pair, weight = pair[near], weight[near]
        by_pair = np.argsort(pair)
        pair = pair[by_pair]
        first = _starts(pair)
        yield int(i), gids, pair[first] // len(values), values[pair[first] % len(values)], np.add.reduceat(weight[by_pair], first)


def _batch(rows: list[tuple[np.ndarray, ...]], schema: str) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    sides = [np.concatenate(side) for side in zip(*rows)] if rows else [[] for _ in fields]
    return pa.table({name: pa.array(side, types[t], from_pandas=False) for (name, t), side in zip(fields, sides)})


def _sizes(kinds: list[str]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        bucket, out = table["bucket"][0].as_py(), []
        for i, gids, group, _, n in _of_groups(table, kinds):
            distinct = np.bincount(group, minlength=len(gids))
            rows = np.bincount(group, n, len(gids)).astype("int64")
            at = np.flatnonzero(distinct)
            out.append((gids[at], np.full(len(at), i), np.full(len(at), bucket), rows[at], distinct[at]))
        return _batch(out, _PARTS)

    return run


def _at_ranks(kinds: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, wanted: pa.Table) -> pa.Table:
        out = []
        if table.num_rows and wanted.num_rows:
            asked = dict(tuple(wanted.to_pandas().groupby("_column")))
            for i, gids, group, value, n in _of_groups(table, kinds, {i: a["_gid"].to_numpy() for i, a in asked.items()}):
                here = asked[i]
                code = pd.Index(gids).get_indexer(here["_gid"])
                upto = np.cumsum(n)
                before = np.r_[0, upto][np.searchsorted(group, code)]
                at = np.searchsorted(upto, before + here["rank"].to_numpy())
                out.append((here["_gid"].to_numpy(), here["_column"].to_numpy(), value[at].astype("float64")))
        return _batch(out, _FOUND)

    return run


def bucket_sizes(blobs: DataFrame, buckets: int, kinds: list[str]) -> DataFrame:
    """``_gid, _column, bucket, rows, distinct``, written: as large as the groups times the buckets."""
    dealt = blobs.repartition(buckets, "bucket").groupBy("bucket")
    return materialize(dealt.applyInArrow(_sizes(kinds), _PARTS), "sizes")


def _named(columns: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in columns]), F.col("_column")).alias("column_name")


def distinct_of_packed(sizes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``_gid, column_name, distinct_count``: a value is in one bucket only."""
    sums = sizes.groupBy("_gid", "_column").agg(F.sum("distinct").alias("distinct_count"))
    return sums.select("_gid", _named(columns), "distinct_count")


def medians_of_packed(
    blobs: DataFrame, buckets: int, sizes: DataFrame, kinds: list[str], columns: Sequence[str], numbers: Sequence[str]
) -> DataFrame:
    """``_gid, column_name, median``: the value at rank ceil(n/2), found in the bucket that holds the rank."""
    which = [i for i, c in enumerate(columns) if c in numbers]
    group = Window.partitionBy("_gid", "_column")
    before = F.sum("rows").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    placed = sizes.where(F.col("_column").isin(which)).select(
        "_gid", "_column", "bucket", "rows",
        F.coalesce(before, F.lit(0)).alias("before"), F.expr("(sum(rows) OVER (PARTITION BY _gid, _column) + 1) div 2").alias("at"),
    )
    rank = F.col("at") - F.col("before")
    wanted = placed.where((rank > 0) & (rank <= F.col("rows"))).select("bucket", "_gid", "_column", rank.alias("rank"))
    wanted = materialize(wanted, "wanted")
    held = blobs.join(wanted.select("bucket").distinct(), "bucket", "left_semi")
    sides = [df.repartition(buckets, "bucket").groupBy("bucket") for df in (held, wanted)]
    found = sides[0].cogroup(sides[1]).applyInArrow(_at_ranks(kinds), _FOUND)
    return found.select("_gid", _named(columns), F.col("value").alias("median"))
