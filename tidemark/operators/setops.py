"""Bag unions of many frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame


def union_positional(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def union_all(frames: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def union_balanced(
    frames: Sequence[DataFrame], combine: Callable[[DataFrame, DataFrame], DataFrame] = DataFrame.union
) -> DataFrame:
    """Pairwise rounds: the plan of n frames is log n deep, not n."""
    frames = list(frames)
    if not frames:
        raise ValueError("nothing to unite")
    while len(frames) > 1:
        pairs = [frames[i : i + 2] for i in range(0, len(frames), 2)]
        frames = [combine(*p) if len(p) == 2 else p[0] for p in pairs]
    return frames[0]
