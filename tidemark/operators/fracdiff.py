"""Fractional differencing with a fixed-width window, and the grid search for the least order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.series import by_series


def ffd_weights(d: float, threshold: float = 1e-5) -> list[float]:
    """Weights of the binomial expansion of (1 - B)^d down to threshold, oldest first."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    weights, k = [1.0], 1
    while True:
        nxt = -weights[-1] * (d - k + 1) / k
        if abs(nxt) <= threshold:
            return weights[::-1]
        weights.append(nxt)
        k += 1


def frac_diff(series: DataFrame, d: float, threshold: float = 1e-3) -> DataFrame:
    """series_id, ts, value: the fractionally differenced series.

    Missing values are carried forward for the window, leading ones dropped; rows whose own value is missing, and rows
    before the window is full, are left out. d = 0 gives the series back. d < 0 raises ValueError; a series not longer than
    the window gives no rows. The window is one array per row folded with the weights inside the JVM.
    """
    if d < 0:
        raise ValueError("d must not be negative")
    if d == 0:
        return series.where("value is not null").select("series_id", "ts", "value")
    weights = ffd_weights(d, threshold)
    width = len(weights) - 1
    w = by_series()
    held = series.select("series_id", "ts", "value", F.last("value", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("held")).where("held is not null")
    framed = held.withColumn("frame", F.collect_list("held").over(w.rowsBetween(-width, 0))).where((F.size("frame") == width + 1) & F.col("value").isNotNull())
    dot = F.aggregate(F.zip_with("frame", F.array(*[F.lit(x) for x in weights]), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return framed.select("series_id", "ts", dot.alias("value"))


def frac_diff_arrays(values: np.ndarray, d: float, threshold: float = 1e-5) -> np.ndarray:
    """The same on one array without gaps, for wide windows: rows with a full window only."""
    weights = np.array(ffd_weights(d, threshold))
    return np.convolve(values, weights[::-1], "valid") if len(values) > len(weights) - 1 else np.array([])


def correlation_grid(series: DataFrame, orders: tuple[float, ...], threshold: float = 1e-2) -> DataFrame:
    """series_id, d, n, corr: correlation of the differenced with the original series for every order."""
    out = None
    for d in orders:
        part = frac_diff(series, d, threshold).withColumnRenamed("value", "diffed").join(series, ["series_id", "ts"])
        one = part.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.corr("diffed", "value").alias("corr")).select("series_id", F.lit(float(d)).alias("d"), "n", "corr")
        out = one if out is None else out.unionByName(one)
    return out
