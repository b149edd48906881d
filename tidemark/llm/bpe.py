"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece there is exactly one last token in its encoding.  It is found
from the tokens that end at that place (one pass of an automaton over the vocabulary gives
them all): the token whose predecessor, the stored last token of the shorter prefix, is
compatible with it.  Two tokens are compatible when merging their joined bytes leaves the
border between them.  Following the stored tokens back from the end gives the ids, exactly
those of merging pair by pair, without simulating the merges of the text.

Documents are rows of a scan; nothing is shuffled.  Each worker keeps the vocabulary, the
compatibility of token pairs it has met and the ids of short pieces it has met, all bounded.

Cases: a null or empty text has no ids and decodes to an empty text; special tokens written
in a text become their id, as in the library; a piece of any length is one run of the
program, in memory in proportion to it; repeated rows are encoded each; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import steps

# The published split pattern of this vocabulary family.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker keeps, in each of two generations, and their greatest length.
KNOWN_PIECES = 250_000
KNOWN_LENGTH = 64
KNOWN_PAIRS = 1_000_000


def byte_characters() -> dict[str, int]:
    """The published mapping of vocabulary characters to bytes.

    Printable bytes stand for themselves; the others, in order, for 256, 257, ...
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Bpe:
    """A byte-level vocabulary file with its encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        of_char = byte_characters()
        raw = lambda token: bytes(of_char[c] for c in token)
        self.bytes_of = {i: raw(t) for t, i in spec["model"]["vocab"].items()}
        id_of = {b: i for i, b in self.bytes_of.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (id_of[raw(t)] for t in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = id_of[self.bytes_of[left] + self.bytes_of[right]]
            self.rank[left, right] = rank
            self.halves.setdefault(whole, (left, right, rank))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        # Only tokens that merging can make: their own two halves must be compatible.
        self.compatible_pairs: dict[int, bool] = {}
        self.right_edges: dict[int, list[tuple[int, float]]] = {}
        self.left_edges: dict[int, list[tuple[int, float]]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, data in self.bytes_of.items():
            if token not in self.special.values() and self.is_made(token):
                self.automaton.add_word(data.decode("latin-1"), (len(data), token))
        self.automaton.make_automaton()
        names = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.pieces = regex.compile(PIECES)
        self.size_of = {i: len(b) for i, b in self.bytes_of.items()}
        self.known: dict[str, tuple[int, ...]] = {n: (i,) for n, i in self.special.items()}
        self.before: dict[str, tuple[int, ...]] = {}

    def is_made(self, token: int) -> bool:
        """Whether merging the token's own bytes ends in that token."""
        if token not in self.halves:
            return len(self.bytes_of[token]) == 1
        left, right, rank = self.halves[token]
        return not self.crosses(left, right, rank)

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces that stand at an end of the token while it forms.

        Each with the rank of the merge that takes it up; the token itself is never taken.
        """
        memo = (self.left_edges, self.right_edges)[side]
        if token not in memo:
            out, whole = [(token, float("inf"))], token
            while whole in self.halves:
                *sides, rank = self.halves[whole]
                whole = sides[side]
                out.append((whole, rank))
            memo[token] = out
        return memo[token]

    def crosses(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Whether a merge over the border comes earlier than rank ``before``.

        It does when two pieces that meet at the border merge before either is taken up on
        its own side.  At equal rank the merge further left goes first.
        """
        for a, a_taken in self.edge(left, 1):
            for b, b_taken in self.edge(right, 0):
                rank = self.rank.get((a, b))
                if rank is not None and rank < before and rank < a_taken and rank <= b_taken:
                    return True
        return False

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        found = self.compatible_pairs.get(key)
        if found is None:
            if len(self.compatible_pairs) >= KNOWN_PAIRS:
                self.compatible_pairs.clear()
            found = self.compatible_pairs[key] = not self.crosses(left, right)
        return found

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece: the last token of every prefix, then back from the end."""
        data = piece.encode().decode("latin-1")
        last = [-1] * (len(data) + 1)
        pairs = self.compatible_pairs
        for end, (size, token) in self.automaton.iter(data):
            end += 1
            if last[end] < 0:
                if size < end:
                    before = last[end - size]
                    fits = pairs.get(before << 20 | token)
                    if fits is None:
                        fits = before >= 0 and self.compatible(before, token)
                    if not fits:
                        continue
                last[end] = token
        ids, end = [], len(data)
        while end:
            token = last[end]
            ids.append(token)
            end -= self.size_of[token]
        ids.reverse()
        return tuple(ids)

    def split(self, text: str) -> list[str]:
        """Pieces of the text, special tokens among them."""
        if self.specials is None or not any(name in text for name in self.special):
            return self.pieces.findall(text)
        out: list[str] = []
        for part in self.specials.split(text):
            out += [part] if part in self.special else self.pieces.findall(part)
        return out

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of the texts.  Pieces of the step are looked up, and new ones encoded, once."""
        split = [self.split(t or "") for t in texts]
        if len(self.known) > KNOWN_PIECES:
            # What is met again moves from the old generation to the new one.
            self.known, self.before = {n: (i,) for n, i in self.special.items()}, self.known
        known, before = self.known, self.before
        long = []
        for piece in set().union(*split) - known.keys():
            known[piece] = before.get(piece) or self.encode_piece(piece)
            if len(piece) > KNOWN_LENGTH:
                long.append(piece)
        ids = [list(chain.from_iterable(map(known.__getitem__, pieces))) for pieces in split]
        for piece in long:
            del known[piece]
        return ids

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    """The vocabulary of a worker, read once."""
    return Bpe(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with a column of ids."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in steps(batches, text_col):
            ids = bpe.encode_batch(batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, to]
            )

    return docs.mapInArrow(step, docs.withColumn(to, F.lit(None).cast("array<int>")).schema)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the text decoded from them."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in steps(batches, text_col):
            counts, ids_digest, text_digest = [], [], []
            for ids in bpe.encode_batch(batch.column(text_col).to_pylist()):
                counts.append(len(ids))
                ids_digest.append(_sha256(",".join(map(bpe.text_of.__getitem__, ids))))
                text_digest.append(_sha256(bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(counts, pa.int64()), pa.array(ids_digest), pa.array(text_digest)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    picked = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias(text_col))
    return picked.mapInArrow(step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
