"""Distribution functions, as numpy code and as pandas UDFs where SQL has none."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution: the regularised upper incomplete gamma function of df/2 and x/2."""
    if x is None or df is None or math.isnan(x) or df <= 0:
        return float("nan")
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    log_front = a * math.log(z) - z - math.lgamma(a)
    if z < a + 1:  # series of the lower function
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - total * math.exp(log_front))
    b = z + 1 - a  # continued fraction of the upper one, by Lentz
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, h * math.exp(log_front))


def normal_cdf(x: float) -> float:
    """Standard normal distribution."""
    return 0.5 * math.erfc(-x / math.sqrt(2))


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """chi2_sf of two columns; one row per series, so the Python hop is small."""
    return pd.Series([chi2_sf(a, int(b)) if a == a and b == b else None for a, b in zip(x, df, strict=True)], dtype="float64")
