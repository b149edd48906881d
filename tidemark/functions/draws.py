"""Reproducible draws: the same row, seed and number give the same value anywhere."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cumulative probabilities of a Poisson(1) count of 0, 1, 2, ..., 12: beyond, a step is
# less than a 32-bit draw can tell.
POISSON_CDF = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(13)]

_PER_HASH = 4  # an md5 text holds four 32-bit draws


def uniform(key: Column, number: Column | int = 0) -> Column:
    """Uniform in [0, 1) from the hash of ``key-number``."""
    number = F.lit(number) if isinstance(number, int) else number
    return _share(F.md5(F.concat_ws("-", key.cast("string"), number.cast("string"))), 0)


def _share(text: Column, place: int) -> Column:
    """The 32 bits at a place of a hash text as a number in [0, 1)."""
    return F.conv(F.substring(text, 1 + 8 * place, 8), 16, 10).cast("double") / 4294967296.0


def uniforms(df: DataFrame, key: Column, count: int, to: str, number: str) -> DataFrame:
    """Every row ``count`` times, with a uniform draw and its number; four draws a hash."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.lit((count - 1) // _PER_HASH)),
        lambda b: F.md5(F.concat_ws("-", key.cast("string"), b.cast("string"))),
    )
    draws = F.flatten(F.transform(blocks, lambda h: F.array(*[_share(h, i) for i in range(_PER_HASH)])))
    return df.select("*", F.posexplode(F.slice(draws, 1, count)).alias(number, to))


# A Poisson count of a mean up to this is drawn from its distribution function; of a larger
# mean, it is the rounded normal of the same mean and variance, whose skewness is less
# than a tenth by then.
LADDER_UPTO = 100
_LADDER = 200


def poisson_of(mean: Column, text: Column, place: int) -> Column:
    """Poisson count of any mean from two 32-bit draws of a hash text."""
    first, second = _share(text, 2 * place), _share(text, 2 * place + 1)
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("below"), F.lit(0).alias("count"))

    def climb(state: Column, j: Column) -> Column:
        p = state["p"] * mean / j
        passed = (first >= state["below"]).cast("int")
        return F.struct(p.alias("p"), (state["below"] + p).alias("below"), (state["count"] + passed).alias("count"))

    ladder = F.aggregate(F.sequence(F.lit(1), F.lit(_LADDER)), start, climb, lambda s: s["count"])
    # 1 - u is never 0.
    normal = F.sqrt(-2 * F.log(1 - first)) * F.cos(2 * math.pi * second)
    large = F.greatest(F.lit(0.0), F.round(mean + F.sqrt(mean) * normal))
    return F.when(mean <= LADDER_UPTO, ladder.cast("long")).otherwise(large.cast("long"))


def row_key(df: DataFrame) -> Column:
    """The whole row as text, for tables without a unique key; NULLs are told from empty texts.

    Equal rows get equal keys, hence equal draws; give a unique key where that matters.
    """
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})


def poisson(hex8: Column) -> Column:
    """Poisson(1) count by the inverse distribution function.

    Eight hex digits compare like the number they spell, so no conversion is needed.
    """
    out = None
    for k, p in enumerate(POISSON_CDF):
        below = hex8 <= F.lit(f"{math.floor(p * 2**32):08x}")
        out = F.when(below, k) if out is None else out.when(below, k)
    return out.otherwise(len(POISSON_CDF))


def poisson_draws(df: DataFrame, key: Column, replicates: int) -> DataFrame:
    """Every row once per replicate, with its count ``weight`` (zeros included)."""
    blocks = math.ceil(replicates / _PER_HASH)
    hashed = df.select("*", key.cast("string").alias("_key")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")
    )
    hashed = hashed.withColumn("_hex", F.md5(F.concat_ws("-", "_key", F.col("_block").cast("string"))))
    weights = F.array(*[poisson(F.substring("_hex", 1 + 8 * i, 8)) for i in range(_PER_HASH)])
    drawn = hashed.select("*", F.posexplode(weights).alias("_pos", "weight"))
    return (
        drawn.withColumn("replicate", F.col("_block") * _PER_HASH + F.col("_pos"))
        .where(F.col("replicate") < replicates)
        .drop("_key", "_block", "_hex", "_pos")
    )


def draw_bytes(key: Column, replicates: int) -> Column:
    """The hashes that ``poisson_draws`` draws from, 16 bytes each, one after the other."""
    blocks = range(math.ceil(replicates / _PER_HASH))
    return F.concat(*[F.unhex(F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(b))))) for b in blocks])


def poisson_weights(drawn: pa.Array, replicates: int) -> np.ndarray:
    """The counts of ``poisson_draws`` from ``draw_bytes``: a row for each, a column per replicate."""
    width = math.ceil(replicates / _PER_HASH) * _PER_HASH
    begin = int.from_bytes(drawn.buffers()[1][4 * drawn.offset : 4 * drawn.offset + 4], "little") if len(drawn) else 0
    words = np.frombuffer(drawn.buffers()[2], ">u4", len(drawn) * width, begin).reshape(-1, width)[:, :replicates]
    steps = np.array([math.floor(p * 2**32) for p in POISSON_CDF], "uint32")
    return np.searchsorted(steps, words.astype("uint32").ravel()).astype("uint8").reshape(words.shape)
