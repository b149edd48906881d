"""Samples and splits that are the same on every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.draws import row_key, uniform


def sample_rows(df: DataFrame, n: int, key: Column | None = None, seed: int = 0) -> DataFrame:
    """``n`` rows by smallest hash: each task keeps its own n, then they are merged."""
    key = row_key(df) if key is None else key
    return df.orderBy(uniform(key, seed), key.cast("string")).limit(n)


def sample_rate(total: int, n: int, margin: float = 1.1) -> float:
    """Share of rows for about ``n`` of ``total``, with a margin, at most all."""
    return min(1.0, margin * n / total) if total else 1.0


def sample_about(
    df: DataFrame, n: int, key: Column | None = None, seed: int = 0, margin: float = 1.1
) -> DataFrame:
    """About ``n`` rows, each kept or not by its own hash; no sort and no shuffle."""
    key = row_key(df) if key is None else key
    return df.where(uniform(key, seed) < sample_rate(df.count(), n, margin))


def split(
    df: DataFrame, weights: Sequence[float], key: Column | None = None, seed: int = 0
) -> list[DataFrame]:
    """Disjoint parts by weight; a row's part depends on its own hash only."""
    key = row_key(df) if key is None else key
    part = split_number(weights, uniform(key, seed))
    return [df.where(part == i) for i in range(len(weights))]


def split_number(weights: Sequence[float], u: Column) -> Column:
    """0-based number of the weight band that ``u`` falls into."""
    total, upto = sum(weights), 0.0
    out = None
    for i, w in enumerate(weights[:-1]):
        upto += w
        inside = u < upto / total
        out = F.when(inside, i) if out is None else out.when(inside, i)
    last = F.lit(len(weights) - 1)
    return last if out is None else out.otherwise(last)


def top_groups(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The ``k`` largest groups, ties by name."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), *keys).limit(k)


def best_threshold(scores: DataFrame, param: str, a: str, b: str) -> DataFrame:
    """Parameter with the highest mean and the one with the highest minimum of two
    scores; the smallest parameter wins a tie."""

    def arg_max(score: Column) -> Column:
        return F.max_by(param, F.struct(score.alias("s"), (-F.col(param)).alias("t")))

    return scores.agg(
        arg_max((F.col(a) + F.col(b)) / 2).alias("best_by_mean"),
        arg_max(F.least(a, b)).alias("best_by_min"),
    )
