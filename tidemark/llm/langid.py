"""Language identification by compression.

Each language has a dictionary of raw text, taken from labelled documents.  A text is
compressed once with each dictionary; the language whose dictionary gives the smallest
result is predicted.  The score is the share that the best dictionary saves over the
second-best.  A text is rejected where that saving is less than a margin, which grows
smoothly with the compressed size from half a byte for a word to six bytes.

Compression sees at most a block of ``block`` characters at a time with a fresh dictionary,
and sizes of all blocks of a text are added, so long texts count whole and the dictionary
is never out of reach.  Every block stands between two frames that all dictionaries hold:
the compressor looks for no match in the last bytes of its input, which would leave a word or
two unread.  Sizes are whole bytes; where the best two are equal, at any length, the text is
compressed between further frames, which round differently, and the sizes are added.

The dictionaries are the one thing fitted: at most ``dictionary_bytes`` of each language, and
``all_bytes`` of all languages, from documents in an order drawn by a hash of their text (a
bounded sample, its bounds parameters).  Of a text longer than a quarter of a dictionary a
piece of that length teaches, at a place drawn by the hash.  Every label has a dictionary.

Cases: a null text or one without a letter is ``und`` with score 0 and rejected; with no
labelled text every text is ``und``; sizes that stay equal go to the language with more labelled
texts, then the first in the alphabet, with score 0, and are rejected unless the margin is 0; a
null label teaches nothing; repeated rows are predicted each; upper case is folded, as case says
nothing of the language; an empty table gives an empty result; columns of the result's names are
replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import steps
from tidemark.session import materialize

DICTIONARY_BYTES = 96 << 10
ALL_BYTES = 24 << 20
LEVEL = 6
BLOCK = 32 << 10
UNKNOWN = "und"
#: Bytes that the best dictionary must save on a long text, and the compressed size at which
#: a quarter of them do.
MARGIN_BYTES = 6.0
QUARTER_MARGIN_SIZE = 50


def dictionaries(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    dictionary_bytes: int = DICTIONARY_BYTES,
    all_bytes: int = ALL_BYTES,
) -> dict[str, bytes]:
    """Raw-content dictionaries, one per language, from a bounded sample of the texts.

    Texts are ranked by a hash of their content, so copies of a text, ranked side by side,
    are taken once.
    """
    known = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = known.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    languages = known.select("lang").distinct().count()
    wanted = min(dictionary_bytes, max(all_bytes // max(languages, 1), 1 << 10))
    piece = wanted // 4
    draw = F.xxhash64("text")
    start = F.pmod(draw, F.greatest(F.char_length("text") - piece, F.lit(0)) + 1).cast("int") + 1
    known = known.select("lang", F.substring("text", start, F.lit(piece)).alias("text"), draw.alias("draw"))
    sums = known.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    # Twice the wanted bytes, so that copies dropped afterwards leave enough.
    keep = 2.0 * wanted / F.col("bytes") + 200 / F.col("rows")
    # One row per language.
    shares = materialize(sums.select("lang", "rows", keep.alias("keep")), "languages")
    # Draws are equal for copies and even over different texts.
    within = F.pmod("draw", F.lit(1 << 30)) / float(1 << 30) < F.col("keep")
    texts = known.join(F.broadcast(shares), "lang").where(within).select("lang", "draw", "text").distinct()
    drawn: dict[str, list[tuple[int, str]]] = {}
    for row in texts.toLocalIterator():
        drawn.setdefault(row["lang"], []).append((row["draw"], row["text"]))
    out = {}
    for lang in [row["lang"] for row in shares.orderBy(F.desc("rows"), "lang").collect()]:
        content = b""
        for _, text in sorted(drawn.get(lang, [])):
            if len(content) >= wanted:
                break
            content += folded(text).encode() + b"\n"
        out[lang] = content
    return out


#: Stand at the end of every dictionary, before and after every text.
FRAME, TAIL = b"0123456789" * 13, b"9876543210" * 4
#: What else may stand before a text; each adds bits of its own.
FRAMES = (FRAME + TAIL[3:20], FRAME + TAIL[3:20] + FRAME[5:30], FRAME + TAIL[1:9] + FRAME[7:19] + TAIL[15:30])

_LETTERS = regex.compile(r"\p{L}+")


def folded(text: str) -> str:
    """Letters in lower case, every other run of characters one blank."""
    return " ".join(_LETTERS.findall(text.lower()))


@lru_cache(maxsize=4)
def compressors(contents: tuple[tuple[str, bytes], ...], level: int):
    """Language names and a compressor for each."""
    out = []
    for _, content in contents:
        data = zstandard.ZstdCompressionDict(content + TAIL + FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=level)
        out.append(
            zstandard.ZstdCompressor(
                level=level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False
            )
        )
    return [lang for lang, _ in contents], out


class Classifier:
    """Predicts a language and a score for texts."""

    def __init__(self, contents: dict[str, bytes], level: int = LEVEL, block: int = BLOCK):
        self.langs, self.own = compressors(tuple(contents.items()), level)
        self.block = block

    def sizes(self, blocks: list[bytes], frame: bytes = FRAME) -> list[int]:
        """Compressed size with each dictionary."""
        framed = [b" ".join((frame, b, TAIL)) for b in blocks]
        return [sum(len(c.compress(b)) for b in framed) for c in self.own]

    def predict(self, text: str | None, margin: float = MARGIN_BYTES) -> tuple[str, float, bool]:
        """Language, score, and whether the prediction is rejected."""
        letters = folded(text or "")
        if not letters or not self.langs:
            return UNKNOWN, 0.0, True
        if len(self.own) == 1:
            return self.langs[0], 1.0, False
        blocks = [letters[i : i + self.block].encode() for i in range(0, len(letters), self.block)]
        sizes, times = self.sizes(blocks), 1
        best, second = sorted(sizes)[:2]
        if best == second:
            more = [self.sizes(blocks, frame) for frame in FRAMES]
            sizes, times = list(map(sum, zip(sizes, *more))), 1 + len(FRAMES)
            best, second = sorted(sizes)[:2]
        saved, size = (second - best) / times, second / times
        least = margin * (size / (size + QUARTER_MARGIN_SIZE)) ** 2
        return self.langs[sizes.index(best)], (second - best) / second, saved < least


def predict(
    docs: DataFrame,
    contents: dict[str, bytes],
    text_col: str = "text",
    margin: float = MARGIN_BYTES,
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``, which replace such columns."""
    kept = docs.drop("lang_pred", "score", "rejected")
    sent = docs.sparkSession.sparkContext.broadcast(contents)  # bounded by languages x bytes

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(sent.value)
        for batch in steps(batches, text_col):
            found = [classifier.predict(t, margin) for t in batch.column(text_col).to_pylist()]
            columns = [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[2] for f in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], [*batch.schema.names, "lang_pred", "score", "rejected"]
            )

    schema = kept.withColumns(
        {"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(False)}
    ).schema
    return kept.mapInArrow(step, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of documents that nothing is learned from; a null id is not in it."""
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))
    return F.coalesce(fold == 2, F.lit(False))


def accepted(docs: DataFrame) -> DataFrame:
    """Documents, columns as given, whose language is predicted with enough margin."""
    contents = dictionaries(docs.where(~held_out()))
    # Columns go by number meanwhile, so that none clashes with the prediction's.
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    flagged = predict(numbered, contents, f"c{docs.columns.index('text')}")
    return flagged.where(~F.col("rejected")).select(*numbered.columns).toDF(*docs.columns)
