"""Distribution functions as column expressions."""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# From so many degrees of freedom on, the expansion in 1/dof is used.
EXPANSION_FROM = 10


def t_share(t: float, dof: int) -> float:
    """Share of the t distribution within -t..t, a finite sum for whole degrees of freedom."""
    angle = math.atan(t / math.sqrt(dof))
    cos2 = math.cos(angle) ** 2
    term = total = 1.0
    for k in range(1, (dof - 1) // 2 if dof % 2 else dof // 2):
        term *= cos2 * ((2 * k) / (2 * k + 1) if dof % 2 else (2 * k - 1) / (2 * k))
        total += term
    if dof % 2 == 0:
        return math.sin(angle) * total
    return 2 / math.pi * (angle + (math.sin(angle) * math.cos(angle) * total if dof > 1 else 0.0))


def t_exact(dof: int, confidence: float) -> float:
    """Two-sided quantile by bisection."""
    low, high = 0.0, 1.0
    while t_share(high, dof) < confidence:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_share(middle, dof) < confidence else (low, middle)
    return high


def t_quantile(dof: Column, confidence: float) -> Column:
    """Two-sided t quantile: Cornish-Fisher in 1/dof, exact values below 10.

    NULL below one degree of freedom.
    """
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    d = F.nullif(dof.cast("double"), F.lit(0.0))
    series = z + g1 / d + g2 / (d * d) + g3 / (d * d * d) + g4 / (d * d * d * d)
    small = F.array(*[F.lit(t_exact(k, confidence)) for k in range(1, EXPANSION_FROM)])
    exact = F.get(small, F.least(dof, F.lit(EXPANSION_FROM)).cast("int") - 1)
    return F.when(dof >= EXPANSION_FROM, series).when(dof >= 1, exact)


def ks_pvalue(statistic: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value.

    Below 0.2 the p-value is 1 to six digits, while the series no longer converges.
    """
    n1, n2 = n1.cast("double"), n2.cast("double")
    lam = statistic * F.sqrt(n1 * n2 / (n1 + n2))
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, j: acc
        + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * lam * lam),
    )
    p = F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * terms)))
    return F.when(statistic.isNotNull(), p)


def chi2_tail(x: float, dof: float) -> float:
    """P(X >= x): upper regularised incomplete gamma by series or continued fraction."""
    if not (x >= 0) or not (dof > 0):
        return math.nan
    if x == 0:
        return 1.0
    a, h = dof / 2, x / 2
    scale = math.exp(a * math.log(h) - h - math.lgamma(a))
    if h < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= h / k
            total += term
        return max(0.0, 1 - total * scale)
    b = h + 1 - a
    c, d = 1e300, 1 / b
    value = d
    for i in itertools.count(1):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        value *= d * c
        if abs(d * c - 1) < 1e-15:
            return scale * value


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    """One value per drift row, never per input row: Spark has no incomplete gamma."""
    return pd.Series(
        [
            chi2_tail(x, k) if pd.notna(x) and pd.notna(k) and k > 0 else None
            for x, k in zip(statistic, dof)
        ],
        dtype="float64",
    )
