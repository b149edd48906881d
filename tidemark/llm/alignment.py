"""Alignment of two tokenizers' tokens over the same bytes.

A text is encoded by both.  Byte offsets where a token of each ends are shared cuts; they cut
the tokens into groups.  The cuts are found by divide and conquer: of an interval of tokens
that begins and ends at shared cuts, tokens of A near the middle are tried, nearest first,
and the end of each is looked for among the ends of B by bisection; a common end halves the
interval, and an interval without one is a group.  All intervals of a step's documents are
halved together, as arrays, and a search without success widens twofold.  In an interval of at
most ``SMALL`` tokens all ends are looked for at once.

A pair of tokens whose byte ranges overlap is a link.  How often two ids are linked is counted
over the whole corpus, so there are two passes: the first encodes, aligns and writes each
document's linked id pairs; these are added up; the second gives every document the counts of
its pairs.  Frequent pairs, at most ``HEAD_PAIRS`` of them whatever the corpus, are sent to
every task; all others are joined by pair, where no key is hot any more, since a pair that is
linked often is a frequent one.

Both encoders are asked once for each distinct unit of text that a worker keeps.  A unit
starts at a blank that follows something other than white space: A's split pattern never
takes such a blank with what is before it, and no piece of B has a blank after another
character.  That is verified when they are loaded; with others whole texts are the units.

Cases: a text that is null or empty, or one of whose joined token bytes differ from blank +
text (as with U+2581 in it), has no tokens, zeros and an empty digest; special tokens written
in a text are plain text; repeated rows are aligned and counted each; a null id stays null; a
long text is one document like any other; an empty table gives an empty result; further
columns are not read, so none clashes.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import Bpe
from tidemark.llm.tokens import slice_hashes, steps, text_buffer
from tidemark.session import materialize

#: Frequent pairs that every task is given, 13 bytes each.
HEAD_PAIRS = 1 << 20
#: Units that a worker keeps, and bytes of them.
KNOWN_UNITS = 500_000
KNOWN_BYTES = 16 << 20
#: Bytes of text that are aligned at a time.
ALIGN_BYTES = 1 << 19
#: Intervals of so few tokens are not halved any more: all their ends are looked for at once.
SMALL = 32


# ---------------------------------------------------------------- divide and conquer


def ranges(lows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers from each low on, ``size`` of them, end to end."""
    return np.arange(sizes.sum()) + np.repeat(lows - (np.cumsum(sizes) - sizes), sizes)


def shared_groups(
    a_ends: np.ndarray, b_ends: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray, small: int = SMALL
) -> tuple[np.ndarray, np.ndarray]:
    """Last token of A and of B of every group, in order.

    ``a_ends`` and ``b_ends`` are ascending byte offsets; ``a_cuts`` and ``b_cuts`` bound the
    intervals to divide (documents), each from one bound to the next, in both counted in tokens.
    """
    a_low, a_high, b_low, b_high = a_cuts[:-1], a_cuts[1:], b_cuts[:-1], b_cuts[1:]
    full = a_high > a_low
    a_low, a_high, b_low, b_high = a_low[full], a_high[full], b_low[full], b_high[full]
    reach = np.full(len(a_low), 2)
    leaves, little = [np.empty((2, 0), np.int64)], []
    while len(a_low):
        done = a_high - a_low <= small
        little.append(np.array([a_low[done], a_high[done]]))
        a_low, a_high, b_low, b_high, reach = (x[~done] for x in (a_low, a_high, b_low, b_high, reach))
        if not len(a_low):
            break
        # The last end of an interval is no cut inside it.
        middle = (a_low + a_high - 2) >> 1
        first, last = np.maximum(a_low, middle - reach + 1), np.minimum(a_high - 1, middle + reach)
        sizes = last - first
        tried = ranges(first, sizes)
        at = np.searchsorted(b_ends, a_ends[tried])
        off = tried - np.repeat(middle, sizes)
        far = np.where(b_ends[at] == a_ends[tried], 2 * np.abs(off) + (off > 0), _FAR)
        nearest = np.minimum.reduceat(far, np.cumsum(sizes) - sizes)
        found = nearest < _FAR
        cutless = ~found & (first == a_low) & (last == a_high - 1)
        leaves.append(np.array([a_high[cutless], b_high[cutless]]) - 1)
        step = nearest[found]
        cut_a = middle[found] + np.where(step & 1, step >> 1, -(step >> 1)) + 1
        cut_b = np.searchsorted(b_ends, a_ends[cut_a - 1]) + 1
        again = ~found & ~cutless
        halves = np.full(len(cut_a), 2)
        a_low, a_high, b_low, b_high, reach = (
            np.concatenate([a_low[again], a_low[found], cut_a]),
            np.concatenate([a_high[again], cut_a, a_high[found]]),
            np.concatenate([b_low[again], b_low[found], cut_b]),
            np.concatenate([b_high[again], cut_b, b_high[found]]),
            np.concatenate([reach[again] * 2, halves, halves]),
        )
    if little:
        # Of small intervals all ends are looked for at once, in ascending order.
        low, high = np.concatenate(little, axis=1)
        order = np.argsort(low)
        tried = ranges(low[order], (high - low)[order])
        at = np.searchsorted(b_ends, a_ends[tried])
        common = b_ends[at] == a_ends[tried]
        leaves.append(np.array([tried[common], at[common]]))
    last_a, last_b = np.concatenate(leaves, axis=1)
    order = np.argsort(last_a, kind="stable")
    return last_a[order], last_b[order]


_FAR = np.iinfo(np.int64).max


# ---------------------------------------------------------------- encoding


class Ragged:
    """Rows of numbers, end to end, in arrays that grow."""

    def __init__(self, dtype: type):
        self.data, self.starts, self.n, self.used = np.empty(1 << 16, dtype), np.zeros(1 << 12, np.int64), 0, 0

    def add(self, data: np.ndarray, sizes: np.ndarray) -> None:
        self.data = _room(self.data, self.used + len(data))
        self.starts = _room(self.starts, self.n + len(sizes) + 1)
        self.data[self.used : self.used + len(data)] = data
        self.starts[self.n + 1 : self.n + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.n, self.used = self.n + len(sizes), self.used + len(data)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' numbers end to end, and how many each has."""
        starts = self.starts[rows]
        sizes = self.starts[rows + 1] - starts
        return self.data[ranges(starts, sizes)], sizes


def _room(data: np.ndarray, size: int) -> np.ndarray:
    if size <= len(data):
        return data
    more = np.zeros(max(size, 2 * len(data)), data.dtype)
    more[: len(data)] = data
    return more


def after_visible(data: np.ndarray) -> np.ndarray:
    """Whether the byte before each is the end of a character other than white space."""
    out = np.zeros(len(data), bool)
    out[1:] = _VISIBLE[data[:-1]]
    # White space of several bytes.
    for space in _WIDE_SPACES:
        n = len(space)
        if len(data) > n:
            held = data[n - 1 : -1] == space[-1]
            if held.any():
                at = np.flatnonzero(held)
                for i, byte in enumerate(space[:-1]):
                    at = at[data[at + i] == byte]
                out[at + n] = False
    return out


_VISIBLE = np.arange(256) > 32
_WIDE_SPACES = [chr(c).encode() for c in range(128, 0x3001) if chr(c).isspace()]


class TwoEncoders:
    """Both encoders with the units met so far."""

    def __init__(self, path_a: str, path_b: str):
        # One thread a task: Spark runs a task on each core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        self.bytes_a, self.by_rank = bytes_and_ranks(path_a, spec)
        self.bytes_b = self.pieces()
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x))) for x in (self.bytes_a, self.bytes_b))
        self.by_units = bool(self.by_rank) and self.cuts_at_blanks()
        self.blank = [self.b.piece_to_id("▁")]
        # What a token's id is written as, followed by a comma, a bar or a semicolon.
        texts = [str(i) for i in range(max(self.size_a, self.size_b))]
        self.written = np.array([t + mark for mark in ",|;" for t in texts], object)
        self.clear()

    def pieces(self) -> list[bytes]:
        b = self.b
        return [
            bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
            for i in range(b.get_piece_size())
        ]

    def cuts_at_blanks(self) -> bool:
        """Whether B encodes units apart as it does side by side."""
        from sentencepiece import sentencepiece_model_pb2 as formats

        spec = formats.ModelProto()
        spec.ParseFromString(self.b.serialized_model_proto())
        how = spec.normalizer_spec
        plain = how.name == "identity" and not how.precompiled_charsmap and how.add_dummy_prefix
        plain = plain and how.escape_whitespaces and not how.remove_extra_whitespaces
        return plain and not any(b" " in piece.lstrip(b" ") for piece in self.bytes_b)

    def clear(self) -> None:
        # Hashes of units in ascending order, and the units' rows.
        self.keys, self.rows = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.text, self.ids_a, self.ids_b = Ragged(np.uint8), Ragged(np.int32), Ragged(np.int32)
        self.fits = np.ones(1 << 12, bool)

    def encode_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units, end to end, and how many each has."""
        if not self.by_rank:
            return _flat([x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)])
        # Units that end in something visible are encoded as one text and cut at their bytes.
        together = [u for u in units if not u[-1].isspace()]
        ids = np.array(self.by_rank.encode_ordinary("".join(together)), np.int64)
        ends = np.cumsum(np.fromiter((len(u.encode()) for u in together), np.int64, len(together)))
        firsts = np.append(0, np.searchsorted(np.cumsum(self.sizes_a[ids]), ends) + 1)
        if len(together) == len(units):
            return ids, np.diff(firsts)
        lists = iter([ids[i:j].tolist() for i, j in zip(firsts[:-1].tolist(), firsts[1:].tolist())])
        return _flat([self.by_rank.encode_ordinary(u) if u[-1].isspace() else next(lists) for u in units])

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows of units that are new, cut from the bytes."""
        raw = data.tobytes()
        units = [raw[i:j] for i, j in zip(starts.tolist(), ends.tolist())]
        if not units:
            return np.empty(0, np.int64)
        texts = [u.decode() for u in units]
        ids_a, sizes_a = self.encode_a(texts)
        # The library adds the blank that a unit starts with, but to nothing.
        lists_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        ids_b, sizes_b = _flat([x or self.blank for x in lists_b])
        first, joined = self.text.n, b"".join(units)
        rows = np.arange(first, first + len(units))
        self.fits = _room(self.fits, first + len(units))
        self.fits[rows] = True
        for ids, sizes, of in ((ids_a, sizes_a, self.bytes_a), (ids_b, sizes_b, self.bytes_b)):
            tokens = list(map(of.__getitem__, ids.tolist()))
            if b"".join(tokens) != joined:
                cuts = np.append(0, np.cumsum(sizes)).tolist()
                same = [b"".join(tokens[i:j]) == u for i, j, u in zip(cuts[:-1], cuts[1:], units)]
                self.fits[rows] &= np.array(same)
        self.text.add(np.frombuffer(joined, np.uint8), ends - starts)
        self.ids_a.add(ids_a, sizes_a)
        self.ids_b.add(ids_b, sizes_b)
        return rows

    def rows_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The known units' rows of the slices of the bytes; new units are learned."""
        keys, first, inverse = np.unique(slice_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        rows = np.empty(len(keys), np.int64)
        rows[known] = self.rows[at[known]]
        new = np.flatnonzero(~known)
        rows[new] = self.learn(data, starts[first[new]], ends[first[new]])
        self.keys, self.rows = np.insert(self.keys, at[new], keys[new]), np.insert(self.rows, at[new], rows[new])
        found = rows[inverse]
        # Hashes only find a row; whether it holds the very unit is seen from the bytes.
        sizes = ends - starts
        same = self.text.starts[found + 1] - self.text.starts[found] == sizes
        held = np.flatnonzero(same)
        places = ranges(self.text.starts[found[held]], sizes[held])
        differs = self.text.data[places] != data[ranges(starts[held], sizes[held])]
        if differs.any():
            same[held] = np.add.reduceat(differs, np.cumsum(sizes[held]) - sizes[held]) == 0
        other = np.flatnonzero(~same)
        found[other] = self.learn(data, starts[other], ends[other])
        return found

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of A and bounds of the texts in them, ids of B and bounds."""
        if self.text.n > KNOWN_UNITS or self.text.used > KNOWN_BYTES:
            self.clear()
        data, offsets = text_buffer(texts)
        full = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][full], 32)
        offsets = offsets + np.append(0, np.cumsum(full))
        opens = np.zeros(len(data), bool)
        if self.by_units:
            opens = (data == 32) & after_visible(data)
        opens[offsets[:-1][full]] = True
        starts = np.flatnonzero(opens)
        units = self.rows_of(data, starts, np.append(starts[1:], len(data))) if len(starts) else starts
        counts = np.diff(np.searchsorted(starts, offsets))
        bad = ~self.fits[units]
        if bad.any():
            rows = np.repeat(np.arange(len(counts)), counts)
            lost = np.zeros(len(counts), bool)
            lost[rows[bad]] = True
            units, counts = units[~lost[rows]], np.where(lost, 0, counts)
        bounds, out = np.append(0, np.cumsum(counts)), []
        for ids in (self.ids_a, self.ids_b):
            found, sizes = ids.of(units)
            out += [found.astype(np.int64), np.append(0, np.cumsum(sizes))[bounds]]
        return out


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, sizes.sum()), sizes


def bytes_and_ranks(path: str, spec: dict) -> tuple[list[bytes], object | None]:
    """Bytes of every token of A, and an encoder that merges by rank where it gives the same ids.

    Merging the pair whose joined bytes come first in the vocabulary, instead of the pair that
    comes first in the list of merges, is the same if merging any token's own bytes ends in that
    token: the bytes of two neighbours that could be joined otherwise would have become the
    token's own two halves before.  That, ids in the order of merges and the published split
    pattern without further steps are verified.
    """
    import tiktoken
    from public_tokenizers import PATTERN

    bpe = Bpe(path)
    out = [bpe.bytes_of.get(i, b"") for i in range(max(bpe.bytes_of) + 1)]
    split = spec["pre_tokenizer"] or {}
    made = [whole for whole in bpe.halves if bpe.is_made(whole)]
    in_order = sorted(bpe.halves, key=lambda i: bpe.halves[i][2]) == sorted(bpe.halves)
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    singles = [i for i, b in bpe.bytes_of.items() if len(b) == 1]
    same = plain and not spec["normalizer"] and len(made) == len(bpe.halves) == len(bpe.rank) and in_order
    same = same and len(singles) == 256 and max(singles) < min(bpe.halves)
    if not same or len(bpe.halves) + 256 + len(bpe.special) != len(bpe.bytes_of):
        return out, None
    ranks = {b: i for i, b in bpe.bytes_of.items() if i not in bpe.special.values()}
    return out, tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def two_encoders(path_a: str, path_b: str) -> TwoEncoders:
    """The encoders of a worker, with what they have met."""
    return TwoEncoders(path_a, path_b)


# ---------------------------------------------------------------- a step's documents


class Aligned:
    """The alignment of a step's documents."""

    def __init__(self, texts: pa.Array, by: TwoEncoders):
        self.by = by
        self.a, self.a_cuts, self.b, self.b_cuts = by.encode(texts)
        # Texts have the same bytes in both, so offsets run through the whole step in both.
        self.a_ends, self.b_ends = np.cumsum(by.sizes_a[self.a]), np.cumsum(by.sizes_b[self.b])
        self.last_a, self.last_b = shared_groups(self.a_ends, self.b_ends, self.a_cuts, self.b_cuts)

    def group_counts(self) -> np.ndarray:
        return np.diff(np.searchsorted(self.last_a, self.a_cuts))

    def written_groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every document."""
        na, nb = len(self.a), len(self.b)
        ends_a, ends_b = np.zeros(na, bool), np.zeros(nb, bool)
        ends_a[self.last_a] = ends_b[self.last_b] = True
        before_a, before_b = np.append(0, self.last_a + 1), np.append(0, self.last_b + 1)
        # A token stands after its group's tokens before it and all of the groups before.
        place_a = np.arange(na) + before_b[np.cumsum(ends_a) - ends_a]
        place_b = np.arange(nb) + before_a[np.cumsum(ends_b) - ends_b + 1] if nb else np.arange(0)
        kinds = len(self.by.written) // 3
        marks = np.empty(na + nb, np.int64)
        marks[place_a] = self.a + kinds * ends_a
        marks[place_b] = self.b + 2 * kinds * ends_b
        texts, cuts = self.by.written[marks].tolist(), (self.a_cuts + self.b_cuts).tolist()
        return ["".join(texts[i:j])[:-1] for i, j in zip(cuts[:-1], cuts[1:])]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in A and in B of the tokens of every link."""
        last = np.searchsorted(self.b_ends, self.a_ends)
        # A token's first link is with the token of B that the one before it ends in, or the next.
        first = np.append(0, last + (self.b_ends[last] == self.a_ends))[:-1]
        sizes = last - first + 1
        return np.repeat(np.arange(len(self.a)), sizes), ranges(first, sizes)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked id pairs of every document, how often each, and the documents' bounds in them."""
        at_a, at_b = self.links()
        rows = np.repeat(np.arange(len(self.a_cuts) - 1), np.diff(self.a_cuts))[at_a]
        span = self.by.size_a * self.by.size_b
        keys, n = np.unique(rows * span + self.a[at_a] * self.by.size_b + self.b[at_b], return_counts=True)
        bounds = np.searchsorted(keys, np.arange(len(self.a_cuts)) * span)
        return keys % span, n, bounds


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts, digest of the groups, and the linked id pairs with their numbers.

    A pair is one number, A's id times the size of B's vocabulary plus B's id.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = two_encoders(path_a, path_b)
        for batch in steps(batches, "text", ALIGN_BYTES):
            found = Aligned(batch.column("text"), by)
            n_a, n_b, n_groups = np.diff(found.a_cuts), np.diff(found.b_cuts), found.group_counts()
            digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in found.written_groups()]
            keys, n, bounds = found.pairs()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_a + n_b - n_groups)),
                    pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys, pa.int64())),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(n, pa.int32())),
                ],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(
        step,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
        " pairs array<long>, times array<int>",
    )


# ---------------------------------------------------------------- counts over the corpus


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """``pair, links, best``: links of every id pair, and whether no pair of its B id has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = materialize(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("links")), "pairs")
    b = (F.col("pair") % size_b).alias("b")
    most = materialize(counts.groupBy(b).agg(F.max("links").alias("most")), "most")
    # A row for each id of B at most.
    joined = counts.withColumn("b", b).join(F.broadcast(most), "b")
    return materialize(joined.select("pair", "links", (F.col("links") == F.col("most")).alias("best")), "pairs")


def frequent_from(counts: DataFrame, at_most: int) -> int:
    """The least power of two that at most so many pairs have as many links as."""
    powers = counts.groupBy(F.floor(F.log2("links")).alias("power")).agg(F.count("*").alias("n"))
    kept, bound = 0, 1 << 62
    # One row for each power of two.
    for row in sorted(powers.collect(), key=lambda r: -r["power"]):
        kept += row["n"]
        if kept > at_most:
            break
        bound = 1 << row["power"]
    return bound


def with_counts(aligned: DataFrame, counts: DataFrame, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` in place of the pairs."""
    bound = frequent_from(counts, head_pairs)
    # At most ``head_pairs`` rows.
    head = counts.where(F.col("links") >= bound).toArrow().sort_by("pair")
    columns = [head.column(c).to_numpy() for c in ("pair", "links", "best")]
    sent = aligned.sparkSession.sparkContext.broadcast(columns)
    plain = [c for c in aligned.columns if c not in ("pairs", "times")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A pair above all others closes the list.
        pair = np.append(sent.value[0], np.iinfo(np.int64).max)
        links, best = np.append(sent.value[1], 0), np.append(sent.value[2], False)
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            keys = lists.flatten().to_numpy()
            bounds = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            at = np.searchsorted(pair, keys)
            known = pair[at] == keys
            n = np.where(known, times, 0).astype(np.int64)
            sums = [np.append(0, np.cumsum(x))[bounds] for x in (n * links[at], n * best[at])]
            rest = np.append(0, np.cumsum(~known))[bounds]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in plain),
                    *(pa.array(np.diff(x), pa.int64()) for x in sums),
                    pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(keys[~known], pa.int64())),
                    pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(times[~known], pa.int32())),
                ],
                names=[*plain, "count_sum", "n_best", "pairs", "times"],
            )

    schema = aligned.select(*plain, F.lit(0).cast("long").alias("count_sum"), F.lit(0).cast("long").alias("n_best"),
                            "pairs", "times").schema
    # Written, as the head's sums and the rest both follow from it, and with a number for each row.
    found = materialize(aligned.mapInArrow(step, schema).withColumn("row", F.monotonically_increasing_id()), "head")
    rare = found.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    rare = rare.select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    of_row = (
        rare.join(counts.where(F.col("links") < bound), "pair")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.col("links")).alias("rare_sum"),
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"),
        )
    )
    return found.join(of_row, "row", "left").select(
        *plain,
        (F.col("n_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"),
    )


def report(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    head_pairs: int = HEAD_PAIRS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: the alignment in numbers, the digest of its groups, its links' corpus-wide counts."""
    aligned = materialize(align(docs, path_a, path_b, id_col, text_col), "aligned")
    counts = pair_counts(aligned, TwoEncoders(path_a, path_b).size_b)
    return with_counts(aligned, counts, head_pairs).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
