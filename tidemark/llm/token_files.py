"""Token ids as flat unsigned integer files with 64-bit document offsets.

A data set is a folder in the shared storage with, for each partition of ascending
document ids, three flat little-endian files and one manifest for all:

* ``<part>.bin``  the ids, one unsigned integer of ``dtype`` each, documents end to end;
* ``<part>.off``  rows + 1 unsigned 64-bit offsets into it, counted in ids;
* ``<part>.doc``  the document ids, signed 64-bit; ``<part>.nul`` a byte each, 1 for null;
* ``manifest.json``  the parts in order with their rows, ids and bases.  A part's base,
  the number of ids before it, is the prefix sum of the sizes of the parts before it.

Documents are range-partitioned by id in one shuffle; each range is sorted, encoded and
written by one task, in steps of bounded size.  A file is written under a name of its own and renamed when complete, so a task can
run twice.  Readers map the files into memory where the shared folder is mounted, and read
ranges of them through the file system's interface elsewhere.

Cases: a null or empty text has the end id only; a null document id comes first; repeated
ids are ordered by hash and text, so their order is fixed; an empty table gives an empty
manifest; a long text is one document like any other.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tokens import runs, slice_hashes, steps, text_buffer
from tidemark.session import scratch_path

END_ID = 2
#: Bytes of text that a part aims at.
PART_BYTES = 32 << 20
#: Units whose ids a worker keeps, in each of two generations, and bytes of text of a step.
KNOWN_UNITS = 400_000
ENCODE_BYTES = 4 << 20


# ---------------------------------------------------------------- encoding


class Memo:
    """Bounded memory in two generations: what is met again moves up, the rest is forgotten."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict[int, bytes] = {}
        self.old: dict[int, bytes] = {}

    def unknown(self, keys: list[int]) -> list[int]:
        """Places of keys to be learned; the others are in the young generation afterwards."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out = []
        for place, key in enumerate(keys):
            if key not in young:
                if key in old:
                    young[key] = old[key]
                else:
                    out.append(place)
        return out


class UnitEncoder:
    """The library's encoder, asked once for each distinct unit of a text.

    The tokenizer drops white space and never merges across it, nor from a letter to a mark
    after it.  So a text is cut there, and its ids are those of its units end to end.  Case
    does not count for the tokenizer, so units of ASCII letters are put in lower case.  A
    step's units are told apart by 64-bit hashes of their bytes, on whole buffers.
    """

    def __init__(self, path: str, dtype: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        # For lower-case ASCII letters the library's own model without the steps before it,
        # which leave such words as they are.
        self.plain = Tokenizer(self.whole.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.dtype, self.memo = np.dtype(dtype), Memo(KNOWN_UNITS)
        self.end = np.array([end_id], self.dtype).tobytes()
        self.mark = self.whole.encode(MARK, add_special_tokens=False).ids

    def learn(self, units: list[str], tokenizer) -> list[bytes]:
        """Packed ids of units.

        They are encoded as one text with a mark between them, which is cheaper than one by
        one; the ids are cut at the mark's id.  Where that does not give as many pieces as
        there are units, because one of them makes the mark's id, they are halved.
        """
        if not units:
            return []
        if len(units) > 1 and len(self.mark) == 1:
            joined = tokenizer.encode(f" {MARK} ".join(units), add_special_tokens=False).ids
            joined = np.array(joined, self.dtype)
            cuts = np.flatnonzero(joined == self.mark[0])
            if len(cuts) == len(units) - 1:
                size, data = self.dtype.itemsize, joined.tobytes()
                starts, ends = np.append(0, cuts + 1) * size, np.append(cuts, len(joined)) * size
                return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
            half = len(units) // 2
            return self.learn(units[:half], tokenizer) + self.learn(units[half:], tokenizer)
        return [np.array(tokenizer.encode(u, add_special_tokens=False).ids, self.dtype).tobytes() for u in units]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text closed by the end id, and the number of each text's."""
        data, offsets = text_buffer(column)
        n = len(offsets) - 1
        letter = _LETTER[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = letter[:-1] & _CUT_BEFORE[data[1:]]
        starts, ends = runs(_VISIBLE[data], offsets, cut)
        sums = np.append(0, np.cumsum(letter))
        pure = sums[ends] - sums[starts] == ends - starts
        data = np.where(np.repeat(pure, ends - starts), data[_VISIBLE[data] > 0] | 32, data[_VISIBLE[data] > 0])
        bounds = np.append(0, np.cumsum(ends - starts))
        hashes = slice_hashes(data, bounds[:-1], bounds[1:])
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        names, known = keys.tolist(), self.memo
        new = np.array(known.unknown(names), np.int64)
        text = data.tobytes()
        for is_pure, tokenizer in ((True, self.plain), (False, self.whole)):
            places = new[pure[first[new]] == is_pure]
            at = first[places]
            units = [text[a:b].decode() for a, b in zip(bounds[at].tolist(), bounds[at + 1].tolist())]
            found = self.learn(units, tokenizer)
            known.young.update(zip((names[i] for i in places.tolist()), found))
        values = [known.young[k] for k in names] + [self.end]
        sizes = np.array([len(v) for v in values], np.int64) // self.dtype.itemsize
        table, table_starts = np.frombuffer(b"".join(values), self.dtype), np.append(0, np.cumsum(sizes))[:-1]
        # The end id is a unit after each text's last.
        firsts = np.searchsorted(starts, offsets)
        order = np.insert(inverse, firsts[1:], len(names))
        lengths = sizes[order]
        places = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths - table_starts[order], lengths)
        rows = np.repeat(np.arange(n), np.diff(firsts) + 1)
        return table[places], np.bincount(rows, lengths, n).astype(np.int64)


#: Between units that are encoded together; a token of its own.
MARK = "`"
_BYTES = np.arange(256)
_LETTER = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) & (_BYTES < 128)
_VISIBLE = (~np.isin(_BYTES, [10, 32])).astype(np.uint8)
#: Marks that may follow a letter without being part of a special token's name or of what
#: the tokenizer joins with letters.
_CUT_BEFORE = np.isin(_BYTES, list(b"!#$%&*+,-./:;=?"))


@lru_cache(maxsize=2)
def unit_encoder(path: str, dtype: str, end_id: int) -> UnitEncoder:
    """The encoder of a worker, with what it has met."""
    return UnitEncoder(path, dtype, end_id)


def id_type(path: str) -> str:
    """The smallest unsigned type that holds every id of the tokenizer."""
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
    return "<u2" if size <= 1 << 16 else "<u4"


# ---------------------------------------------------------------- files


def shared(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a place in the shared storage."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


class PartWriter:
    """One part's files, filled a row at a time and renamed when complete."""

    def __init__(self, folder: str, part: int, dtype: str):
        self.fs, self.folder = shared(folder)
        self.name, self.attempt = f"{part:08d}", uuid.uuid4().hex
        self.part = part
        self.sizes, self.docs = [0], []
        self.out = self.fs.open_output_stream(self.path("bin"))

    def path(self, kind: str, final: bool = False) -> str:
        return f"{self.folder}/{self.name}{'' if final else '.' + self.attempt}.{kind}"

    def add(self, docs: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.out.write(ids.tobytes())
        self.sizes += sizes.tolist()
        self.docs += docs

    def close(self) -> tuple[int, int, int]:
        self.out.close()
        offsets = np.cumsum(np.array(self.sizes, "<u8"), dtype="<u8")
        columns = {
            "off": offsets.tobytes(),
            "doc": np.array([d or 0 for d in self.docs], "<i8").tobytes(),
            "nul": np.array([d is None for d in self.docs], np.uint8).tobytes(),
        }
        for kind, data in columns.items():
            with self.fs.open_output_stream(self.path(kind)) as out:
                out.write(data)
        for kind in ("bin", *columns):
            self.fs.move(self.path(kind), self.path(kind, final=True))
        return self.part, len(self.docs), int(offsets[-1])


def write(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_bytes: int = PART_BYTES,
) -> dict:
    """Encode ``docs`` and write them in ascending id order; returns the manifest."""
    spark, dtype = docs.sparkSession, id_type(tokenizer_path)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(-(-int(size) // part_bytes), spark.sparkContext.defaultParallelism)
    fs, path = shared(folder)
    fs.create_dir(path, recursive=True)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = unit_encoder(tokenizer_path, dtype, end_id), None
        for batch in steps(batches, "text", ENCODE_BYTES):
            # An attempt that starts over starts with a new file.
            writer = writer or PartWriter(folder, batch.column("part")[0].as_py(), dtype)
            writer.add(batch.column("doc_id").to_pylist(), *encoder.encode(batch.column("text")))
        done = [writer.close()] if writer else []
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in done], pa.int64()) for i in range(3)], ["part", "rows", "ids"]
        )

    # Equal ids are ordered by text; the salt lets rows equal in both go to several parts.
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("hash"),
        F.rand(0).alias("salt"),
    )
    placed = (
        rows.repartitionByRange(parts, "doc_id", "hash", "salt")
        .sortWithinPartitions("doc_id", "hash", "text")
        .select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "text")
    )
    # One row per part comes back, a number that the part size bounds.
    sizes = sorted(tuple(r) for r in placed.mapInArrow(step, "part long, rows long, ids long").collect())
    bases = np.cumsum([0] + [s[2] for s in sizes])
    manifest = {
        "dtype": dtype,
        "end_id": end_id,
        "parts": [{"part": p, "rows": r, "ids": n, "base": int(b)} for (p, r, n), b in zip(sizes, bases)],
    }
    with fs.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


# ---------------------------------------------------------------- reading


class Part:
    """One part, mapped into memory where its folder is mounted."""

    def __init__(self, folder: str, part: int, dtype: str):
        self.fs, path = shared(folder)
        self.base, self.dtype = f"{path}/{part:08d}", np.dtype(dtype)
        self.offsets = self._map("off", "<u8")
        self.docs, self.null = self._map("doc", "<i8"), self._map("nul", "u1")
        if isinstance(self.fs, pafs.LocalFileSystem):
            self.ids, self.file = self._map("bin", dtype), None
        else:
            self.ids, self.file = None, self.fs.open_input_file(f"{self.base}.bin")

    def _map(self, kind: str, dtype: str) -> np.ndarray:
        if isinstance(self.fs, pafs.LocalFileSystem):
            if not self.fs.get_file_info(f"{self.base}.{kind}").size:
                return np.empty(0, dtype)
            return np.memmap(f"{self.base}.{kind}", dtype, "r")
        with self.fs.open_input_file(f"{self.base}.{kind}") as file:
            return np.frombuffer(file.read(), dtype)

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, row: int) -> tuple[int | None, int, np.ndarray]:
        """Document id, place of its first id in the part, its ids."""
        start, stop = int(self.offsets[row]), int(self.offsets[row + 1])
        if self.ids is not None:
            ids = self.ids[start:stop]
        else:
            size = self.dtype.itemsize
            ids = np.frombuffer(self.file.read_at((stop - start) * size, start * size), self.dtype)
        return None if self.null[row] else int(self.docs[row]), start, ids


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: place of its first id, ids with the end id, their crc."""
    fs, path = shared(folder)
    with fs.open_input_file(f"{path}/manifest.json") as file:
        manifest = json.loads(file.read())
    dtype, parts = manifest["dtype"], [(p["part"], p["base"]) for p in manifest["parts"]]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist()):
                part = Part(folder, number, dtype)
                for first in range(0, len(part), 4096):
                    rows = [part[i] for i in range(first, min(first + 4096, len(part)))]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r[0] for r in rows], pa.int64()),
                            pa.array([base + r[1] for r in rows], pa.int64()),
                            pa.array([len(r[2]) for r in rows], pa.int64()),
                            pa.array([zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows], pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    listing = spark.createDataFrame(parts or [], "part long, base long").repartition(max(1, len(parts)))
    return listing.mapInArrow(step, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to a new folder in the shared storage and read the files back."""
    folder = scratch_path(docs.sparkSession, "token-files")
    write(docs, folder, tokenizer_path, end_id)
    return read(docs.sparkSession, folder)
