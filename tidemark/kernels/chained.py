"""Chained-equation imputation of a numeric matrix with Bayesian ridge regressions."""

from __future__ import annotations

import numpy as np


def bayes_ridge(x: np.ndarray, y: np.ndarray, rounds: int = 60, prior: float = 1e-6) -> tuple[np.ndarray, float]:
    """Coefficients and intercept; noise and weight precision by evidence maximisation."""
    mx, my = x.mean(axis=0), y.mean()
    c, t = x - mx, y - my
    n = len(t)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    eigen, projected = s**2, u.T @ t
    noise, weight = 1 / max(t.var(), 1e-12), 1.0
    for _ in range(rounds):
        beta = vt.T @ (s * projected / (eigen + weight / noise))
        free = float((noise * eigen / (weight + noise * eigen)).sum())
        rss = float(((t - c @ beta) ** 2).sum())
        new = (free + 2 * prior) / (float(beta @ beta) + 2 * prior), (n - free + 2 * prior) / (rss + 2 * prior)
        if abs(new[0] - weight) + abs(new[1] - noise) < 1e-4 * (abs(weight) + abs(noise)):
            break
        weight, noise = new
    return beta, float(my - mx @ beta)


def impute(matrix: np.ndarray, rounds: int = 10, tolerance: float = 1e-3) -> np.ndarray:
    """The matrix with NaN filled; observed cells are unchanged, columns without any value become 0.

    Start with column means, then predict each column from all others, fewest gaps first, until little changes.
    """
    x = np.array(matrix, float)
    gaps = ~np.isfinite(x)
    empty = gaps.all(axis=0)
    x[:, empty] = 0.0
    gaps[:, empty] = False
    means = np.array([x[~g, k].mean() if (~g).any() else 0.0 for k, g in enumerate(gaps.T)])
    x[gaps] = np.take(means, np.nonzero(gaps)[1])
    order = [k for k in np.argsort(gaps.sum(axis=0), kind="stable") if gaps[:, k].any()]
    if x.shape[1] < 2:
        return x
    limit = tolerance * max(float(np.abs(x[~gaps]).max()) if (~gaps).any() else 1.0, 1e-12)
    for _ in range(rounds):
        before = x.copy()
        for k in order:
            others = np.delete(x, k, axis=1)
            beta, cut = bayes_ridge(others[~gaps[:, k]], x[~gaps[:, k], k])
            x[gaps[:, k], k] = others[gaps[:, k]] @ beta + cut
        if np.abs(x - before).max() < limit:
            break
    return x
