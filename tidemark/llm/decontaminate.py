"""Benchmark decontamination with suffix arrays of the training text.

Every task builds suffix arrays over shards of its documents' words and binary-searches
every suffix of every benchmark item in them.  A search gives the longest verbatim match
of that suffix with its place, and at window length the range of all occurrences, whose
words are marked.  Documents are never shuffled: a shard is what a task reads anyway.

The benchmark is the stated query set.  It is sent to the tasks in blocks of at most
``block_chars`` characters, each searched by one more step of the same scan, so a task
holds one block at a time; the driver holds the benchmark.

Cases: a null or empty text has no words, is not contaminated and matches nothing; an item
without words has no window; equal items count once by their id; repeated documents are
judged each on its own; a null item id is written as an empty string; a document longer
than a shard is a shard of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import separated, steps, suffix_array, text_buffer, word_hashes

WINDOW = 10
BLOCK_CHARS = 8 << 20
# Names of the columns that carry the state from block to block.
WORDS, MARKS, ITEMS, LONGEST = "llm:words", "llm:marks", "llm:items", "llm:longest"


@dataclass
class Queries:
    """The suffixes of a block of items: word hashes, and for each suffix its item."""

    words: np.ndarray
    item: np.ndarray  # of each word
    end: np.ndarray  # of each word's item
    width: np.ndarray  # of each word's window; 0 where none starts
    ids: list[str]

    @classmethod
    def of(cls, ids: list, texts: list, window: int) -> Queries:
        data, offsets = text_buffer(pa.array(texts, pa.string()))
        words, firsts = word_hashes(data, offsets)
        counts = np.diff(firsts)
        item = np.repeat(np.arange(len(ids)), counts)
        end = firsts[1:][item]
        size = np.minimum(counts, window)[item]
        starts = np.arange(len(words)) + size <= end
        return cls(words, item, end, np.where(starts, size, 0), ["" if i is None else str(i) for i in ids])


class Shard:
    """Suffix array over the words of some documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words, self.firsts = word_hashes(data, offsets)
        self.known, symbols = np.unique(words, return_inverse=True)
        self.text, self.row = separated(symbols, self.firsts, len(self.known))
        self.order = suffix_array(self.text)

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """The shard's symbols of words; -1 for one that it does not hold."""
        if not len(self.known):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        return np.where(self.known[at] == words, at, -1)

    def bound(self, low, high, depth: int, symbol, after: bool) -> np.ndarray:
        """Binary search of many ranges at once for the symbol at ``depth``."""
        low, high = low.copy(), high.copy()
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high) >> 1
            found = self.text[self.order[np.where(open_, middle, 0)] + np.where(open_, depth, 0)]
            right = open_ & ((found <= symbol) if after else (found < symbol))
            low = np.where(right, middle + 1, low)
            high = np.where(open_ & ~right, middle, high)

    def search(self, queries: Queries):
        """Per query suffix: longest match, one place of it; and the ranges of its window."""
        n = len(queries.words)
        symbol = self.symbols(queries.words)
        longest, place = np.zeros(n, np.int64), np.full(n, -1)
        ranges: list[tuple[np.ndarray, ...]] = []
        active = np.arange(n)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.order))
        depth = 0
        while len(active):
            wanted = symbol[active + depth]
            first = self.bound(low, high, depth, wanted, False)
            last = self.bound(first, high, depth, wanted, True)
            found = (wanted >= 0) & (first < last)
            active, low, high = active[found], first[found], last[found]
            depth += 1
            longest[active], place[active] = depth, self.order[low]
            full = queries.width[active] == depth
            if full.any():
                ranges.append((active[full], low[full], high[full], np.full(full.sum(), depth)))
            more = active + depth < queries.end[active]
            active, low, high = active[more], low[more], high[more]
        columns = [np.concatenate(x) for x in zip(*ranges)] if ranges else [np.empty(0, np.int64)] * 4
        return longest, place, columns


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, and the range of each."""
    sizes = high - low
    which = np.repeat(np.arange(len(low)), sizes)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which], which


def marked(shard: Shard, queries: Queries):
    """Hit words as a mask over the shard's text, items of each row, longest match of each row."""
    longest, place, (suffix, low, high, width) = shard.search(queries)
    change = np.zeros(len(shard.text) + 1, np.int64)
    at, which = spread(low, high)
    np.add.at(change, shard.order[at], 1)
    np.add.at(change, shard.order[at] + width[which], -1)
    pairs = np.unique(shard.row[shard.order[at]] * (len(queries.ids) + 1) + queries.item[suffix][which])
    best = np.zeros(len(shard.firsts) - 1, np.int64)
    seen = place >= 0
    np.maximum.at(best, shard.row[place[seen]], longest[seen])
    return np.cumsum(change[:-1]) > 0, np.divmod(pairs, len(queries.ids) + 1), best


def search_block(text_col: str, ids: list, texts: list, window: int):
    """A step of the scan that adds what one block of items finds to the state."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries.of(ids, texts, window)
        for batch in steps(batches, text_col):
            shard = Shard(*text_buffer(batch.column(text_col)))
            hit, (rows, items), best = marked(shard, queries)
            counts = np.diff(shard.firsts)
            edges = shard.firsts + np.arange(len(shard.firsts))
            old = {c: batch.column(c).to_pylist() for c in (MARKS, ITEMS, LONGEST)}
            n = batch.num_rows
            marks = list(old[MARKS])
            for row in np.flatnonzero(np.add.reduceat(hit, edges[:-1])) if n else ():
                own = hit[edges[row] : edges[row + 1] - 1]
                if marks[row]:
                    own = own | np.unpackbits(np.frombuffer(marks[row], np.uint8), count=len(own)).astype(bool)
                marks[row] = np.packbits(own).tobytes()
            names = [x or [] for x in old[ITEMS]]
            for row, item in zip(rows.tolist(), items.tolist()):
                names[row] = [*names[row], queries.ids[item]]
            state = {
                WORDS: pa.array(counts, pa.int64()),
                MARKS: pa.array(marks, pa.binary()),
                ITEMS: pa.array([sorted(set(x)) for x in names], pa.list_(pa.string())),
                LONGEST: pa.array(np.maximum(best, old[LONGEST]), pa.int64()),
            }
            yield pa.RecordBatch.from_arrays(
                [state.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)], batch.schema.names
            )

    return step


def blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[tuple[list, list]]:
    """The items in blocks of bounded size; only one block at a time is on the driver."""
    ids, texts, size = [], [], 0
    for row in items.select(F.col(id_col), F.col(text_col)).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1] or "")
        if size >= block_chars:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def matches(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Every row of ``docs`` with four state columns (names above).

    The marks are a bit per word, null where none is hit; the items the sorted ids of
    items with a window in the text; the longest is the longest verbatim match in words that
    ends a search in this document.
    """
    state = docs.withColumns(
        {
            WORDS: F.lit(0).cast("long"),
            MARKS: F.lit(None).cast("binary"),
            ITEMS: F.array().cast("array<string>"),
            LONGEST: F.lit(0).cast("long"),
        }
    )
    found = False
    for ids, texts in blocks(items, item_id, item_text, block_chars):
        state, found = state.mapInArrow(search_block(text_col, ids, texts, window), state.schema), True
    return state if found else state.mapInArrow(search_block(text_col, [], [], window), state.schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, hit words, items, digest of the items, and the verdict."""
    found = matches(docs.select("doc_id", "text"), items, window)
    return found.mapInArrow(_digest, DIGEST)


DIGEST = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
    "contaminated boolean, longest_match long"
)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = [
            0 if m is None else int(np.unpackbits(np.frombuffer(m, np.uint8)).sum())
            for m in batch.column(MARKS).to_pylist()
        ]
        items = batch.column(ITEMS).to_pylist()
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column(WORDS),
                pa.array(hits, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array(digests),
                pa.array([h > 0 for h in hits]),
                batch.column(LONGEST),
            ],
            [c.split()[0] for c in DIGEST.split(", ")],
        )


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, columns as given, that hold no window of any item."""
    found = matches(docs, items, window)
    return found.where(F.col(MARKS).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
