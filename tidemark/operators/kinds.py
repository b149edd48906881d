"""What a column holds: dates, numbers, categories or text."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import col, string_columns
from tidemark.operators.counts import value_counts

# Fixed list: the date and time layouts that count as a date.
DATETIME_FORMATS = [
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "d MMM yyyy",
    "MMM d, yyyy",
    "d MMMM yyyy",
]

# Cardinality limits for numbers that may be codes.
CATEGORICAL_BELOW = 40
STRONG_NUMERIC_FROM = 250
STRONG_CATEGORICAL_UPTO = 10
SAMPLES = 5

#: Symbols of the language model: a blank, the letters, and one for all signs beyond ASCII.
SYMBOLS = " abcdefghijklmnopqrstuvwxyz~"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: How steeply the mean log-likelihood ratio of a text's pairs turns into a confidence.
STEEPNESS = 20.0


def parsed_datetime(c: Column, formats: Sequence[str] = DATETIME_FORMATS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def datetime_columns(
    df: DataFrame, columns: Sequence[str] | None = None, formats: Sequence[str] = DATETIME_FORMATS
) -> DataFrame:
    """``column_name, is_datetime``: some value is a date and at most one distinct value,
    NULL included, is not.

    Two or more distinct failing values show as a smallest and a largest one that
    differ, so the test is one plain aggregate over the whole table.
    """
    columns = list(columns or string_columns(df))
    picked = df.select(
        *[
            F.struct(col(c).alias("v"), parsed_datetime(col(c), formats).isNotNull().alias("ok")).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    )
    aggs = []
    for i, name in enumerate(columns):
        v, ok = F.col(f"c{i}.v"), F.col(f"c{i}.ok")
        bad = F.when(~ok, v)
        distinct = F.when(F.min(bad).isNull(), 0).when(F.min(bad) == F.max(bad), 1).otherwise(2)
        nulls = F.when(F.count_if(v.isNull()) > 0, 1).otherwise(0)
        aggs.append(
            F.struct(
                F.lit(name).alias("column_name"),
                ((F.count_if(ok) > 0) & (distinct + nulls <= 1)).alias("is_datetime"),
            )
        )
    return picked.agg(F.array(*aggs).alias("_rows")).select(F.inline("_rows"))


def column_profiles(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: total and distinct values, and five sampled distinct values.

    The sample is the values with the smallest hashes; each task keeps its own five
    before the shuffle.
    """
    columns = list(columns or df.columns)
    texts = df.select(*[col(c).cast("string").alias(c) for c in columns])
    counts = value_counts(texts, [], columns)
    sizes = counts.groupBy("column_name").agg(
        F.sum("n").alias("total_vals"), F.count("*").alias("num_of_dist_val")
    )
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.md5("txt"), "txt"))
    five = (
        counts.withColumn("_rank", rank)
        .where(F.col("_rank") <= SAMPLES)
        .groupBy("column_name")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "txt"))), lambda s: s["txt"]).alias("samples"))
    )
    return sizes.join(five, "column_name")


def all_numbers(samples: Column) -> Column:
    return F.forall(samples, lambda s: s.try_cast("double").isNotNull())


def numeric_kind(profiles: DataFrame, below: int = CATEGORICAL_BELOW) -> DataFrame:
    """Add ``kind``: text and numbers of few distinct values are categorical."""
    categorical = ~all_numbers(F.col("samples")) | (F.col("num_of_dist_val") < below)
    return profiles.withColumn("kind", F.when(categorical, "categorical").otherwise("numeric"))


def is_strong_numeric(cardinality: Column, samples: Column, limit: Column, below: int = CATEGORICAL_BELOW) -> Column:
    fraction = F.exists(
        samples, lambda s: s.try_cast("double") != F.floor(s.try_cast("double")).cast("double")
    )
    return all_numbers(samples) & (cardinality >= below) & (fraction | (cardinality >= limit))


def is_strong_categorical(cardinality: Column, samples: Column, limit: Column) -> Column:
    return ~all_numbers(samples) | (cardinality <= limit)


def numeric_strength(profiles: DataFrame) -> DataFrame:
    """Add ``kind``: strong or weak, numeric or categorical."""
    n, s = F.col("num_of_dist_val"), F.col("samples")
    return profiles.withColumn(
        "kind",
        F.when(is_strong_numeric(n, s, F.lit(STRONG_NUMERIC_FROM)), "strong_numeric")
        .when(is_strong_categorical(n, s, F.lit(STRONG_CATEGORICAL_UPTO)), "strong_categorical")
        .when(n >= CATEGORICAL_BELOW, "weak_numeric")
        .otherwise("weak_categorical"),
    )


def folded(text: Column) -> Column:
    """The text in the model's symbols: runs of other signs are one blank, a blank at both ends."""
    lower = F.translate(text, _UPPER, _LOWER)
    plain = F.regexp_replace(lower, "[^\\x00-\\x7F]+", "~")
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(plain, "[^a-z~]+", " ")), F.lit(" "))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, though it stands in lambdas of ``use``."""
    return F.element_at(F.transform(F.array(value), use), 1)


def symbol_pairs(text: Column) -> Column:
    """Numbers of the pairs of neighbouring symbols, in order."""
    width = len(SYMBOLS)
    codes = F.transform(F.split(folded(text), ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)

    def pairs(known: Column) -> Column:
        after = F.slice(known, 2, F.size(known) - 1)
        both = F.zip_with(F.slice(known, 1, F.size(known) - 1), after, lambda a, b: a * width + b)
        return F.filter(both, lambda n: n >= 0)

    # The engine ends a split at the empty pattern with an empty text, which has no symbol.
    return _bound(F.filter(codes, lambda c: c >= 0), pairs)


#: Symbol of every byte; those beyond ASCII are a symbol of their own while runs are told apart.
_BEYOND = len(SYMBOLS)
_SYMBOL_OF = np.array(
    [SYMBOLS.find(chr(b).lower()) if chr(b).isalpha() or chr(b) == "~" else 0 for b in range(128)] + [_BEYOND] * 128, dtype=np.int16
)
#: Bytes of text that are looked at together; a longer text alone.
_TOGETHER = 1 << 20


def _pairs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``symbol_pairs`` of texts in UTF-8: the pairs of all, in order, and the place of each one's text.

    Texts stand between blanks, which two neighbours share; a pair belongs to the text of its sign.
    """
    whole = _SYMBOL_OF[np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", dtype=np.uint8)]
    place = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    place = np.append(0, place)
    # A run of blanks, and one of bytes beyond ASCII, is one symbol.
    run = (whole[1:] == whole[:-1]) & ((whole[1:] == 0) | (whole[1:] == _BEYOND))
    kept = np.append(True, ~run)
    codes, place = np.where(whole == _BEYOND, _BEYOND - 1, whole)[kept].astype(np.int64), place[kept]
    pairs, owner = codes[:-1] * len(SYMBOLS) + codes[1:], np.where(codes[:-1] != 0, place[:-1], place[1:])
    # A text of blanks alone is two blanks.
    empty = np.flatnonzero(np.bincount(owner, minlength=len(texts)) == 0)
    return np.append(pairs, np.zeros(len(empty), dtype=np.int64)), np.append(owner, empty)


def _pieces(texts: Sequence[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in pieces of about ``_TOGETHER`` bytes, each with the place of its first one."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > _TOGETHER:
            yield start, list(texts[start:i])
            start, size = i, 0
        size += len(text) + 1
    if len(texts):
        yield start, list(texts[start:])


@dataclass(frozen=True)
class LanguageModel:
    """Log-likelihood ratio of every pair of symbols, one language over the others."""

    ratios: tuple[float, ...]

    def evidence(self, text: Column) -> Column:
        """``struct<total, pairs>``: the sum of the ratios over a whole text, and their number."""
        ratios = np.array([float(f"{r:.6f}") for r in self.ratios])

        @F.pandas_udf("total double, pairs int")
        def summed(texts: pd.Series) -> pd.DataFrame:
            known, total, pairs = texts.notna(), np.full(len(texts), np.nan), np.zeros(len(texts), dtype=np.int64)
            at = np.flatnonzero(known)
            for first, piece in _pieces(texts[known].tolist()):
                found, owner = _pairs_of(piece)
                here = at[first : first + len(piece)]
                total[here] = np.bincount(owner, weights=ratios[found], minlength=len(piece))
                pairs[here] = np.bincount(owner, minlength=len(piece))
            counts = pd.Series(pairs, dtype="Int32").where(known.to_numpy())
            return pd.DataFrame({"total": total, "pairs": counts})

        return summed(text.cast("string").cast("binary"))


def confidence(total: Column, pairs: Column) -> Column:
    """Between 0 and 1; a half without evidence."""
    return 1 / (1 + F.exp(-STEEPNESS * F.coalesce(total / F.nullif(pairs, F.lit(0)), F.lit(0.0))))


def fit_language(labelled: DataFrame, text: str, is_language: Column) -> LanguageModel:
    """Fitted from labelled rows: counts of symbol pairs with and without the label, each plus one.

    Pairs are summed up where they stand; at most twice ``len(SYMBOLS) ** 2`` counts come back.
    """
    known = labelled.where(is_language.isNotNull() & col(text).isNotNull())
    size = len(SYMBOLS) ** 2

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for y, texts in frame.groupby("y")["t"]:
                sums = np.zeros(size, dtype=np.int64)
                for _, piece in _pieces(texts.tolist()):
                    sums += np.bincount(_pairs_of(piece)[0], minlength=size)
                pairs = np.flatnonzero(sums)
                yield pd.DataFrame({"y": y, "pair": pairs.astype("int32"), "n": sums[pairs]})

    each = known.select(is_language.alias("y"), col(text).cast("string").cast("binary").alias("t"))
    summed = each.mapInPandas(counted, "y boolean, pair int, n bigint").groupBy("y", "pair").agg(F.sum("n").alias("n"))
    counts = {(r["y"], r["pair"]): r["n"] for r in summed.collect()}
    totals = {y: sum(n for (z, _), n in counts.items() if z == y) for y in (True, False)}

    def log_share(y: bool, pair: int) -> float:
        return math.log((counts.get((y, pair), 0) + 1) / (totals[y] + size))

    return LanguageModel(tuple(log_share(True, i) - log_share(False, i) for i in range(size)))


def english_scores(
    df: DataFrame, text: str, model: LanguageModel, keys: Sequence[str] = (), row_cut: float = 0.5
) -> DataFrame:
    """Three confidences that a text column is English, and its share of distinct values.

    ``by_rows`` is the mean confidence of the texts, ``by_share`` the share of rows above
    ``row_cut``, ``by_concat`` the confidence from the evidence of all texts together.
    """
    scored = df.where(col(text).isNotNull()).select(
        *[col(k) for k in keys], col(text).alias("_t"), model.evidence(col(text)).alias("_e")
    )
    total, pairs = F.col("_e.total"), F.col("_e.pairs")
    # Grouped by the text's hash first, so that distinct texts can be counted without
    # shuffling the texts themselves.
    per_text = scored.groupBy(*keys, F.sha2("_t", 256).alias("_h")).agg(
        F.count("*").alias("n"), F.first(total).alias("total"), F.first(pairs).alias("pairs")
    )
    n, sure = F.col("n"), confidence(F.col("total"), F.col("pairs"))
    return per_text.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        (F.count("*") / F.sum("n")).alias("percent_distinct"),
        (F.sum(sure * n) / F.sum("n")).alias("by_rows"),
        (F.sum(F.when(sure > row_cut, n).otherwise(0)) / F.sum("n")).alias("by_share"),
        confidence(F.sum(F.col("total") * n), F.sum(F.col("pairs") * n)).alias("by_concat"),
    )


def is_text(percent_distinct: Column, confidence: Column, p: Column, c: Column) -> Column:
    return (percent_distinct >= p) & (confidence >= c)


def with_grid(df: DataFrame, **grids: Sequence[float]) -> DataFrame:
    """Every row once per combination of the grid values, exploded in place.

    The grids are short literal lists, so no join is involved.
    """
    for name, values in grids.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df
