"""Seasonal ARMA by two least-squares stages (long autoregression, then lags and its residuals), order choice by AIC."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np

from tidemark.kernels.regression import least_squares


@dataclass
class Arma:
    """Lags of the values and of the shocks with their coefficients, constant, shock variance, AIC and fitted shocks."""

    lags: list[int]
    shocks: list[int]
    beta: np.ndarray
    sigma2: float
    aic: float
    residuals: np.ndarray

    def forecast(self, y: np.ndarray, steps: int) -> np.ndarray:
        """Values ahead, future shocks being 0."""
        values, e = list(y), list(self.residuals)
        for _ in range(steps):
            x = [values[-k] for k in self.lags] + [e[-k] for k in self.shocks] + [1.0]
            values.append(float(np.dot(self.beta, x)))
            e.append(0.0)
        return np.array(values[len(y) :])


def _design(y: np.ndarray, e: np.ndarray, lags: list[int], shocks: list[int], skip: int) -> np.ndarray:
    rows = np.arange(skip, len(y))
    return np.column_stack([*[y[rows - k] for k in lags], *[e[rows - k] for k in shocks], np.ones(len(rows))])


def long_residuals(y: np.ndarray, most: int) -> np.ndarray:
    """Shocks of a long autoregression; 0 where there is no history yet."""
    k = min(most, len(y) // 4)
    if k < 1:
        return y - y.mean()
    lags = list(range(1, k + 1))
    x = _design(y, y, lags, [], k)
    beta, _, _ = least_squares(x, y[k:])
    return np.concatenate([np.zeros(k), y[k:] - x @ beta])


def fit_arma(y: np.ndarray, p: int, q: int, seasonal_p: int = 0, seasonal_q: int = 0, period: int = 1, shocks: np.ndarray | None = None, skip: int | None = None) -> Arma | None:
    """One order; None if the series is too short. skip: rows left out at the start, for comparing orders on one sample."""
    lags = sorted({*range(1, p + 1), *(period * k for k in range(1, seasonal_p + 1))})
    ma = sorted({*range(1, q + 1), *(period * k for k in range(1, seasonal_q + 1))})
    e = long_residuals(y, max(10, 2 * period)) if shocks is None else shocks
    start = max([0, *lags, *ma]) if skip is None else skip
    if len(y) - start < 3 * (len(lags) + len(ma) + 1):
        return None
    x = _design(y, e, lags, ma, start)
    beta, _, rss = least_squares(x, y[start:])
    n = len(y) - start
    sigma2 = max(rss / n, 1e-300)
    return Arma(lags, ma, beta, sigma2, n * math.log(2 * math.pi * sigma2) + n + 2 * (len(beta) + 1), np.concatenate([np.zeros(start), y[start:] - x @ beta]))


def best_seasonal(y: np.ndarray, period: int, most: tuple[int, int, int, int] = (2, 2, 1, 1)) -> tuple[tuple[int, int, int, int], Arma] | None:
    """The order (p, q, P, Q) of least AIC but (0, 0, 0, 0); None if no order fits the length."""
    e = long_residuals(y, max(10, 2 * period))
    found = []
    for order in itertools.product(*(range(k + 1) for k in most)):
        if any(order):
            model = fit_arma(y, order[0], order[1], order[2], order[3], period, e, skip=max(most[0], most[1], period if period > 1 else 1))
            if model is not None:
                found.append((model.aic, order, model))
    if not found:
        return None
    best = min(found, key=lambda f: f[:2])
    return best[1], best[2]


def best_arima(y: np.ndarray, orders: tuple[range, range, range] = (range(4), range(3), range(4))) -> tuple[tuple[int, int, int], Arma] | None:
    """The order (p, d, q) of least AIC. AICs of different d are compared as they are, a convention of grid searches."""
    found = []
    for d in orders[1]:
        z = np.diff(y, d)
        e = long_residuals(z, 10)
        for p, q in itertools.product(orders[0], orders[2]):
            model = fit_arma(z, p, q, shocks=e, skip=4)
            if model is not None:
                found.append((model.aic, (p, d, q), model))
    if not found:
        return None
    best = min(found, key=lambda f: f[:2])
    return best[1], best[2]


def forecast_arima(y: np.ndarray, order: tuple[int, int, int], model: Arma, steps: int) -> np.ndarray:
    """Values ahead on the undifferenced scale."""
    levels = [y]
    for _ in range(order[1]):
        levels.append(np.diff(levels[-1]))
    out = model.forecast(levels[-1], steps)
    for level in reversed(levels[:-1]):
        out = level[-1] + np.cumsum(out)
    return out
