"""Secret scans: three fixed kinds by pattern, and random strings by character Markov models.

Two models of character pairs, one of random strings and one of ordinary identifiers, are
trained from labelled samples: values that the patterns found in a bounded sample of
documents, with drawn strings of the common alphabets, against the plain words of the same
documents.  A long run of identifier characters is a secret where the first model explains
it better: the log-likelihood ratio per pair passes a threshold.

Everything is column expressions.  Positions come from the lengths of what a pattern finds
and of what lies between, so they count code points.  The models are one array of at most
``(len(ALPHABET) + 1) ** 2`` numbers; it is the only thing that reaches the driver.

Cases: an empty table has no rows; columns of the input are kept or not read, so none clashes; a
null or empty text has no spans; matches of a kind do not overlap, those of
different kinds may; a span of the models never overlaps one of the patterns; without any
sample both models are uniform and add nothing; repeated rows are scanned each; long texts
are scanned whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in order, with pattern and the least length of the pattern's second
# group, if that counts.  A run of one class is one match, so a least length of the whole
# match can be a count in the pattern: 18 characters with AKIA, 16 of hex.
KINDS = [
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
    ),
    ("access", r"AKIA[A-Z0-9]{14,}", 0),
    ("hex", r"[0-9a-f]{16,}", 0),
]
#: Patterns that find whatever a kind finds, to pass over texts without.
HINTS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"' :=]",
    "access": r"AKIA[A-Z0-9]{14}",
    "hex": r"[0-9a-f]{16}",
}
RANDOM = "random"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Length of runs that the models judge, and the ratio per pair of characters they must pass.
RUN_LENGTH = 20
THRESHOLD = 0.5
_CLASS = "[A-Za-z0-9+/_=-]"
RUN = f"(?<!{_CLASS}){_CLASS}{{{RUN_LENGTH},}}"
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z_]{6,}(?![A-Za-z0-9+/_=-])"
#: Documents that the models are trained from, at most, and strings drawn besides.
SAMPLE_DOCUMENTS = 20_000
DRAWN_STRINGS = 2_000

#: Matches of a text that are placed one after the other.
BLOCK = 256

SPAN = "struct<start:int,stop:int,rank:int,kind:string,value:string>"


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, though it stands in lambdas of ``use``."""
    return F.element_at(F.transform(F.array(value), use), 1)


def located(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """Array of the pattern's matches with their places, leftmost and non-overlapping.

    Matches are gone through in blocks, whose lengths are added up first: no array grows by
    one element per match of the text, which would take the square of their number.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)

    def pairs_of(matches: Column) -> Column:
        return F.zip_with(
            F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match"))
        )

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        stop = start + F.char_length(pair["match"])
        span = F.struct(
            start.alias("start"), stop.alias("stop"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
            pair["match"].alias("value"),
        )
        return F.struct(stop.alias("at"), F.array_append(state["spans"], span).alias("spans"))

    def within(block: Column, at: Column) -> Column:
        nothing = F.struct(at.alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
        return F.aggregate(block, nothing, add)["spans"]

    def length(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda n, pair: n + pair["gap"] + F.char_length(pair["match"]))

    def over(blocks: Column) -> Column:
        begins = F.aggregate(
            blocks, F.array(F.lit(0)), lambda sums, block: F.array_append(sums, F.element_at(sums, -1) + length(block))
        )
        return F.flatten(F.zip_with(blocks, F.slice(begins, 1, F.size(blocks)), within))

    def blocks_of(pairs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / F.lit(BLOCK)).cast("int"))
        return F.transform(numbers, lambda i: F.slice(pairs, i * BLOCK + 1, F.lit(BLOCK)))

    none = F.array().cast(f"array<{SPAN}>")
    whole = bound(found, lambda m: F.when(F.size(m) > 0, bound(bound(pairs_of(m), blocks_of), over)).otherwise(none))
    return whole


def base_spans(text: Column) -> Column:
    """Spans of the three kinds that reach their least length."""
    none = F.array().cast(f"array<{SPAN}>")
    kinds = []
    for rank, (kind, pattern, least) in enumerate(KINDS):
        spans = located(text, pattern, kind, rank)
        if least:
            spans = F.filter(
                spans, lambda s: F.char_length(F.regexp_extract(s["value"], pattern, 2)) >= least
            )
        kinds.append(F.when(text.rlike(HINTS[kind]), spans).otherwise(none))
    return F.concat(*kinds)


# ---------------------------------------------------------------- models


@dataclass(frozen=True)
class Models:
    """Log-likelihood ratio of every pair of characters, random over ordinary, row by row."""

    ratios: tuple[float, ...]

    def score(self, value: Column) -> Column:
        """Ratio per pair of the string's characters."""
        width = len(ALPHABET) + 1
        # One literal: a text that the engine turns into an array once, when it plans.
        table = F.split(F.lit(",".join(f"{r:.5f}" for r in self.ratios)), ",").cast("array<double>")
        code = lambda i: F.instr(F.lit(ALPHABET), value.substr(i, F.lit(1)))
        pairs = F.sequence(F.lit(1), F.char_length(value) - 1)
        total = F.aggregate(pairs, F.lit(0.0), lambda s, i: s + F.get(table, code(i) * width + code(i + 1)))
        return F.when(F.char_length(value) > 1, total / (F.char_length(value) - 1)).otherwise(F.lit(0.0))


def _pairs(strings: DataFrame) -> DataFrame:
    """Counts of character pairs of the ``value`` column by label."""
    places = F.sequence(F.lit(1), F.char_length("value") - 1)
    pair = F.explode(F.transform(places, lambda i: F.col("value").substr(i, F.lit(2)))).alias("pair")
    return strings.where(F.char_length("value") > 1).select("label", pair).groupBy("label", "pair").count()


def train(
    docs: DataFrame,
    text_col: str = "text",
    sample_documents: int = SAMPLE_DOCUMENTS,
    drawn_strings: int = DRAWN_STRINGS,
    id_col: str = "doc_id",
) -> Models:
    """Both models, from at most about ``sample_documents`` documents and drawn strings.

    Documents are drawn by a hash of id and text, so copies of a text are drawn one by one.
    """
    spark = docs.sparkSession
    rows = docs.count()
    share = min(1.0, sample_documents / max(rows, 1))
    text = F.col(text_col)
    of = [text, *([F.col(id_col)] if id_col in docs.columns else [])]
    drawn = F.pmod(F.xxhash64(*of), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = docs.where(text.isNotNull() & drawn).select(text.alias("text"))
    spans = sample.select(F.explode(base_spans(F.col("text"))).alias("span"))
    value = F.regexp_extract("span.value", "([A-Za-z0-9+/_=-]+)$", 1)
    found = spans.select(F.lit(1).alias("label"), value.alias("value"))
    words = sample.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("value"))
    words = words.select(F.lit(0).alias("label"), "value")
    digest = F.sha2(F.col("id").cast("string"), 256)
    letters = F.translate(digest, "0123456789abcdef", "GHJKLMNPQRSTUVWX")
    mixed = F.base64(F.unhex(digest))
    strings = spark.range(drawn_strings).select(
        F.lit(1).alias("label"), F.explode(F.array(digest, mixed, letters)).alias("value")
    )
    counts = {(r[0], r[1]): r[2] for r in _pairs(found.union(words).union(strings)).collect()}
    return Models(tuple(_ratios(counts)))


def _ratios(counts: dict[tuple[int, str], int]) -> list[float]:
    symbols = [None, *ALPHABET]
    first = {label: dict.fromkeys(symbols, 0) for label in (0, 1)}
    for (label, pair), n in counts.items():
        if pair[0] in first[label] and pair[1] in first[label]:
            first[label][pair[0]] += n
    out = []
    for a in symbols:
        for b in symbols:
            logs = [
                math.log((counts.get((label, f"{a}{b}"), 0) + 0.5) / (first[label][a] + 0.5 * len(ALPHABET)))
                for label in (1, 0)
            ]
            out.append(logs[0] - logs[1] if a and b else 0.0)
    return out


# ---------------------------------------------------------------- scans


def model_spans(text: Column, models: Models, rank: int = len(KINDS)) -> Column:
    """Runs that the models call random."""
    runs = F.filter(located(text, RUN, RANDOM, rank), lambda s: models.score(s["value"]) >= THRESHOLD)
    return F.when(text.rlike(RUN), runs).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan(docs: DataFrame, models: Models, text_col: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """``docs`` with two columns: the spans of the patterns, and all spans, both in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Structs order by start, then stop; a kind has no two spans with one start.
    order = lambda a, b: F.when(
        (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["rank"] < b["rank"])), -1
    ).otherwise(1)
    found = docs.withColumn(base, base_spans(text)).withColumn(spans, model_spans(text, models))
    apart = lambda s: ~F.exists(
        F.col(base), lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])
    )
    every = F.concat(F.col(base), F.filter(F.col(spans), apart))
    in_order = lambda c: F.when(F.size(c) > 1, F.array_sort(c, order)).otherwise(c)
    return found.withColumn(spans, in_order(every)).withColumn(base, in_order(F.col(base)))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def report(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: spans of each kind, digest of the patterns' spans, all spans."""
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), models)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind, *_ in KINDS],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redacted(docs: DataFrame, models: Models, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans become one mark.

    A column ``n_chars``, if there is one, follows the new text.
    """
    spans = "llm:spans"
    found = scan(docs, models, text_col, "llm:base", spans).drop("llm:base")
    text = F.col(f"`{text_col}`")

    def add(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        between = text.substr(state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        return F.struct(
            F.greatest(state["at"], span["stop"]).alias("at"),
            F.when(fresh, F.array_append(state["out"], F.concat(between, F.lit(mark))))
            .otherwise(state["out"])
            .alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    finish = lambda s: F.concat(
        F.array_join(s["out"], ""), text.substr(s["at"] + 1, F.char_length(text))
    )
    clean = F.when(F.size(f"`{spans}`") > 0, F.aggregate(F.col(f"`{spans}`"), start, add, finish)).otherwise(text)
    out = found.withColumn(text_col, clean).drop(spans)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
