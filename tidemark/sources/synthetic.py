"""Seeded synthetic series, for tests and examples."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, SparkSession

START = dt.date(2000, 1, 1)


def as_series(spark: SparkSession, **values: np.ndarray) -> DataFrame:
    """series_id, ts (daily from 2000-01-01), value."""
    rows = [(name, START + dt.timedelta(days=i), float(v)) for name, xs in values.items() for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "series_id string, ts date, value double")


def random_walk(length: int = 1000, start: float = 0.0, seed: int = 42) -> np.ndarray:
    """Start plus the running sum of standard normal steps."""
    return start + np.cumsum(np.random.default_rng(seed).normal(size=length))


def autoregression(length: int = 1000, rho: float = 0.5, sigma: float = 0.1, seed: int = 42) -> np.ndarray:
    """x = rho * x before + noise; abs(rho) must be under 1."""
    if abs(rho) >= 1:
        raise ValueError("rho must lie between -1 and 1")
    noise = np.random.default_rng(seed).normal(0, sigma, length)
    out = np.zeros(length)
    for i in range(1, length):
        out[i] = rho * out[i - 1] + noise[i]
    return out


def trending(length: int = 1000, trend: float = 0.01, sigma: float = 0.1, seed: int = 42) -> np.ndarray:
    """A line plus noise."""
    return trend * np.arange(length) + np.random.default_rng(seed).normal(0, sigma, length)


def coupled_maps(length: int = 500, rx: float = 3.8, ry: float = 3.5, coupling: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Two logistic maps, the first driving the second."""
    x, y = np.full(length, 0.4), np.full(length, 0.2)
    for i in range(length - 1):
        x[i + 1] = min(0.999, max(0.001, x[i] * (rx - rx * x[i])))
        y[i + 1] = min(0.999, max(0.001, y[i] * (ry - ry * y[i] - coupling * x[i])))
    return x, y


# What each series of causal_system is to Y.
CAUSES = {"X1": "indirect cause", "X2": "direct linear cause", "X3": "direct nonlinear cause", "X4": "noise"}


def causal_system(length: int = 200, seed: int = 42) -> dict[str, np.ndarray]:
    """X1 (a chaotic map), X2 and X3 (driven by X1, linearly and by a sine), X4 (noise) and Y (driven by X2 and the square of X3).

    Every influence takes one step; what is true of the system is in CAUSES.
    """
    rng = np.random.default_rng(seed)
    shocks = rng.normal(0, 0.05, (length, 2))
    state = np.zeros((length, 4))
    state[0] = 0.1
    for i in range(1, length):
        a, b, c, y = state[i - 1]
        state[i] = min(1.0, max(0.0, 3.9 * a * (1 - a))), 0.8 * b + 0.5 * a + shocks[i, 0], 0.5 * c + 0.6 * np.sin(5 * a), 0.5 * y + 0.4 * b + 0.5 * c**2 + shocks[i, 1]
    return {"X1": state[:, 0], "X2": state[:, 1], "X3": state[:, 2], "X4": rng.normal(size=length), "Y": state[:, 3]}
