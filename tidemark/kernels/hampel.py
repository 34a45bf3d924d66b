"""Numpy kernels of the spike and stuck-value search: one block of a source's readings in time order."""

from __future__ import annotations

import numpy as np

#: Bins of absolute deviations: this many to an octave, so a bin is 0.07 % wide.
BINS_PER_OCTAVE = 1024
#: Bin of the deviation 0.
ZERO_BIN = -(1 << 30)


def rolling_median(x: np.ndarray, half: int) -> np.ndarray:
    """Median of the 2*half+1 values around each value, fewer at the ends."""
    n = len(x)
    if n == 0:
        return x.astype(float)
    half = min(half, max(n - 1, 0))
    padded = np.concatenate([np.full(half, np.nan), x, np.full(half, np.nan)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1)
    out = np.empty(n)
    inner = slice(half, max(half, n - half))
    if inner.stop > inner.start:
        out[inner] = np.median(view[inner], axis=1)
    edge = np.r_[0 : min(half, n), max(half, n - half) : n]
    if len(edge):
        out[edge] = np.nanmedian(view[edge], axis=1)
    return out


def deviations(x: np.ndarray, half: int) -> np.ndarray:
    """Signed distance of each value from the median of its surroundings."""
    return x - rolling_median(x, half)


def deviation_bins(dev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the absolute deviations that occur, in order, and how often each does."""
    size = np.abs(dev)
    bins = np.full(len(size), ZERO_BIN, np.int64)
    some = size > 0
    bins[some] = np.floor(np.log2(size[some]) * BINS_PER_OCTAVE).astype(np.int64)
    return np.unique(bins, return_counts=True)


def smallest_step(x: np.ndarray) -> float:
    """Smallest difference other than 0 between neighbours in time; infinite if there is none."""
    steps = np.abs(np.diff(x))
    steps = steps[steps > 0]
    return float(steps.min()) if len(steps) else float("inf")


def run_lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and lengths of the runs of one value."""
    if not len(x):
        return np.array([], int), np.array([], int)
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return start, np.diff(np.r_[start, len(x)])
