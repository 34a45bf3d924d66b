"""Seasonal-trend decomposition by LOESS, with robustness weights, on evenly spaced values."""

from __future__ import annotations

import numpy as np


def loess(y: np.ndarray, span: int, weights: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """Local linear regression with tricube weights over the span nearest points, at positions (default: all)."""
    n = len(y)
    x = np.arange(n, dtype=float)
    at = x if at is None else np.asarray(at, float)
    w0 = np.ones(n) if weights is None else weights
    q = min(span, n)
    start = np.clip(np.round(at - (q - 1) / 2).astype(int), 0, n - q)
    index = start[:, None] + np.arange(q)[None]
    d = np.abs(x[index] - at[:, None])
    reach = np.maximum(d.max(axis=1), 1e-9) * (1 if span <= n else span / n)
    w = np.clip(1 - np.minimum(d / reach[:, None], 1) ** 3, 0, None) ** 3 * w0[index]
    total = w.sum(axis=1)
    flat = total < 1e-12
    w[flat] = 1.0
    total = w.sum(axis=1)
    mx, my = (w * x[index]).sum(axis=1) / total, (w * y[index]).sum(axis=1) / total
    dx = x[index] - mx[:, None]
    sxx, sxy = (w * dx * dx).sum(axis=1), (w * dx * (y[index] - my[:, None])).sum(axis=1)
    slope = np.where(sxx > 1e-12, sxy / np.maximum(sxx, 1e-12), 0.0)
    return my + slope * (at - mx)


def moving_average(x: np.ndarray, k: int) -> np.ndarray:
    """Mean of k neighbours, shorter by k - 1."""
    c = np.concatenate([[0.0], np.cumsum(x)])
    return (c[k:] - c[:-k]) / k


def decompose(y: np.ndarray, period: int, seasonal: int = 7, inner: int = 2, outer: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal and rest; they add up to y. Fewer than two periods give a trend only."""
    y = np.asarray(y, float)
    n = len(y)
    if period < 2 or n < 2 * period:
        trend = loess(y, max(5, n // 3)) if n > 2 else y.copy()
        return trend, np.zeros(n), y - trend
    odd = lambda k: int(np.ceil(k)) | 1
    trend_span, low_span = odd(1.5 * period / (1 - 1.5 / seasonal)), odd(period)
    trend, season, robust = np.zeros(n), np.zeros(n), np.ones(n)
    for _ in range(outer + 1):
        for _ in range(inner):
            detrended = y - trend
            cycle = np.zeros(n + 2 * period)
            for k in range(period):
                part = detrended[k::period]
                ends = np.arange(-1, len(part) + 1)
                cycle[k::period][: len(ends)] = loess(part, seasonal, robust[k::period], ends)
            low = loess(moving_average(moving_average(moving_average(cycle, period), period), 3), low_span)
            season = cycle[period : period + n] - low[:n]
            trend = loess(y - season, trend_span, robust)
        rest = y - trend - season
        h = 6 * np.median(np.abs(rest))
        robust = np.clip(1 - (np.abs(rest) / h) ** 2, 0, None) ** 2 if h > 0 else np.ones(n)
    return trend, season, y - trend - season
