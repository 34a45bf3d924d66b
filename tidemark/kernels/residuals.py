"""Tests on residuals: normality, flatness of the spectrum, autocorrelation."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

from tidemark.functions.special import chi2_sf, normal_cdf

# Polynomials of Royston's approximation (1995) to the Shapiro-Wilk test, lowest power first.
LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
MEAN_SMALL, SD_SMALL, GAMMA = (0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322), (-2.273, 0.459)
MEAN_LARGE, SD_LARGE = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def _poly(c: tuple[float, ...], x: float) -> float:
    return sum(a * x**k for k, a in enumerate(c))


def shapiro(x: np.ndarray) -> tuple[float, float]:
    """W and p of the Shapiro-Wilk test over all values (its p is only approximate over 5000); NaN for fewer than 4 or constant ones."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 4 or x[0] == x[-1]:
        return float("nan"), float("nan")
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = float(m @ m), 1 / math.sqrt(n)
    a = m / math.sqrt(mm)
    last = a[-1] + _poly(LAST, u)
    if n > 5:
        second = a[-2] + _poly(SECOND, u)
        phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a = m / math.sqrt(phi)
        a[-2], a[1] = second, -second
    else:
        phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a = m / math.sqrt(phi)
    a[-1], a[0] = last, -last
    w = min(float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()), 1.0)
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        y, mean, sd = -math.log(max(_poly(GAMMA, n) - y, 1e-300)), _poly(MEAN_SMALL, n), math.exp(_poly(SD_SMALL, n))
    else:
        mean, sd = _poly(MEAN_LARGE, math.log(n)), math.exp(_poly(SD_LARGE, math.log(n)))
    return w, 1 - normal_cdf((y - mean) / sd)


def welch(x: np.ndarray, segment: int = 256) -> np.ndarray:
    """One-sided power density over half-overlapping Hann segments, each without its mean, up to a constant factor."""
    x = np.asarray(x, float)
    k = min(segment, len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(k) / k)
    starts = range(0, len(x) - k + 1, max(1, k - k // 2))
    power = np.mean([np.abs(np.fft.rfft((x[s : s + k] - x[s : s + k].mean()) * window)) ** 2 for s in starts], axis=0)
    power[1 : (-1 if k % 2 == 0 else None)] *= 2
    return power


def spectrum_variation(x: np.ndarray) -> float:
    """Deviation of the power density over its mean; small for white noise."""
    p = welch(x)
    return float(p.std() / p.mean()) if p.mean() > 0 else float("nan")


def autocorrelations(x: np.ndarray, lags: int) -> np.ndarray:
    """Biased autocorrelations at lags 1..lags."""
    c = x - x.mean()
    total = float(c @ c)
    return np.array([float(c[k:] @ c[:-k]) / total if total > 0 else 0.0 for k in range(1, lags + 1)])


def ljung_box(x: np.ndarray, lags: int) -> tuple[float, float]:
    """Statistic and p."""
    n, lags = len(x), min(lags, len(x) - 1)
    if lags < 1:
        return float("nan"), float("nan")
    r = autocorrelations(x, lags)
    q = float(n * (n + 2) * (r**2 / (n - np.arange(1, lags + 1))).sum())
    return q, chi2_sf(q, lags)
