"""Words, n-grams and suffix arrays over Arrow text, as numpy work on whole buffers.

A word is a run of ASCII letters, digits and bytes above 0x7F, with A-Z lower-cased.
Texts never become Python strings here: a batch is one byte buffer with offsets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that one step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 21

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_IN_WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
# Kinds of bytes: 0 blanks and controls, 1 of words, 2 marks.
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_MARKS = np.where(_IN_WORD | _UPPER, 1, np.where((_BYTES > 32) & (_BYTES < 127), 2, 0)).astype(np.uint8)
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_GRAM = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], column: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes of text each, whole rows."""
    for batch in batches:
        _, offsets = text_buffer(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and the first word's index of every row (rows + 1 long)."""
    low = _LOWER[data]
    return _run_hashes(low, _IN_WORD[low].view(np.uint8), offsets)


def mark_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, for words as written and for the runs of marks between them."""
    return _run_hashes(data, _MARKS[data], offsets)


def _run_hashes(data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the longest runs of bytes of one kind, other than kind 0, inside rows."""
    starts, ends = runs(kind, offsets)
    return slice_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def runs(kind: np.ndarray, offsets: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of one kind; ``cut`` marks further places to start at."""
    n = len(kind)
    change = np.ones(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[offsets[offsets < n]] = True
    if cut is not None:
        change[:-1] |= cut
    return np.flatnonzero(change[:-1] & (kind > 0)), np.flatnonzero(change[1:] & (kind > 0)) + 1


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every slice of the bytes."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64)
    up, down = _powers(max(n - 1, 1).bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[:n], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word runs inside rows, and the row of each.

    A row with fewer words, but not none, has one run of all its words.
    """
    n = len(words)
    rows = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    if not n:
        return np.empty(0, np.uint64), rows
    total = np.zeros(n, np.uint64)
    last = firsts[1:][rows]
    place = np.arange(n)
    whole = place + size <= last
    short = (np.diff(firsts) < size)[rows] & (place == firsts[:-1][rows])
    for k in range(size):
        at = place + k
        value = np.where(at < last, words[np.minimum(at, n - 1)], np.uint64(0))
        total += mixed(value + np.uint64(k)) * _GRAM[k]
    keep = whole | short
    return mixed(total[keep]), rows[keep]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of an integer sequence whose last symbol occurs once.

    Prefix doubling; each round sorts only the suffixes that are still tied.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    if n < 2:
        return order
    sorted_symbols = symbols[order]
    opens = np.empty(n, bool)
    opens[0] = True
    opens[1:] = sorted_symbols[1:] != sorted_symbols[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    active = _tied(np.arange(n), opens)
    depth = 1
    while len(active):
        which = order[active]
        key = rank[which] * (n + 1) + rank[np.minimum(which + depth, n - 1)]
        by = np.argsort(key, kind="stable")
        which, key = which[by], key[by]
        order[active] = which
        opens = np.empty(len(key), bool)
        opens[0] = True
        opens[1:] = key[1:] != key[:-1]
        rank[which] = np.maximum.accumulate(np.where(opens, active, 0))
        active = _tied(active, opens)
        depth *= 2
    return order


def _tied(places: np.ndarray, opens: np.ndarray) -> np.ndarray:
    alone = opens & np.append(opens[1:], True)
    return places[~alone]


def separated(symbols: np.ndarray, firsts: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' symbols in one sequence, each row closed by a symbol of its own.

    Returns the sequence and, for each place, its row.  No match runs over a row's end.
    """
    counts = np.diff(firsts)
    rows = np.repeat(np.arange(len(counts)), counts + 1)
    out = np.empty(len(rows), np.int64)
    closing = np.cumsum(counts + 1) - 1
    body = np.ones(len(rows), bool)
    body[closing] = False
    out[body] = symbols
    out[closing] = base + np.arange(len(counts))
    return out, rows
