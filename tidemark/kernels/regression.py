"""Least squares, unit-root test and neighbour regression on arrays."""

from __future__ import annotations

import math

import numpy as np

from tidemark.functions.special import normal_cdf

# Response surface of the Dickey-Fuller critical values with a constant (1, 5, 10 %), and of its p-value.
CRITICAL = {0.01: (-3.43035, -6.5393, -16.786, -79.433), 0.05: (-2.86154, -2.8903, -4.234, -40.040), 0.10: (-2.56677, -1.5384, -2.809, 0.0)}
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)


def least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, their standard errors and the residual sum of squares."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rss = float(((y - x @ beta) ** 2).sum())
    free = max(len(y) - x.shape[1], 1)
    cov = np.linalg.pinv(x.T @ x) * rss / free
    return beta, np.sqrt(np.maximum(np.diag(cov), 0)), rss


def _dickey_fuller_design(y: np.ndarray, lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(y)
    rows = np.arange(skip, len(d))
    columns = [y[rows], *[d[rows - k] for k in range(1, lags + 1)], np.ones(len(rows))]
    return np.column_stack(columns), d[rows]


def adf(y: np.ndarray, max_lag: int | None = None) -> dict[str, float]:
    """Augmented Dickey-Fuller test with a constant; lag by AIC on a common sample, then refitted.

    Fewer than 10 values or a constant series give a statistic of NaN and p = 1.
    """
    y = np.asarray(y, float)
    n = len(y)
    if n < 10 or np.ptp(y) == 0:
        return {"stat": float("nan"), "p": 1.0, "lag": 0, "crit5": CRITICAL[0.05][0]}
    top = min(int(math.ceil(12 * (n / 100) ** 0.25)) if max_lag is None else max_lag, n // 2 - 3)
    best = (math.inf, 0)
    for k in range(top + 1):
        x, d = _dickey_fuller_design(y, k, top)
        rss = least_squares(x, d)[2]
        aic = len(d) * math.log(max(rss, 1e-300) / len(d)) + 2 * x.shape[1]
        best = min(best, (aic, k))
    x, d = _dickey_fuller_design(y, best[1], best[1])
    beta, se, _ = least_squares(x, d)
    stat = float(beta[0] / se[0]) if se[0] > 0 else float("nan")
    crit = lambda level: sum(c / len(d) ** k for k, c in enumerate(CRITICAL[level]))
    return {"stat": stat, "p": adf_p(stat), "lag": best[1], "crit5": crit(0.05)}


def adf_p(stat: float) -> float:
    """p-value of a Dickey-Fuller statistic with a constant."""
    if not math.isfinite(stat) or stat > 2.74:
        return 1.0
    if stat < -18.83:
        return 0.0
    terms = SMALL_P if stat <= -1.61 else LARGE_P
    return normal_cdf(sum(c * stat**k for k, c in enumerate(terms)))


def ridge(x: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Coefficients and intercept; the intercept is not penalised."""
    mx, my = x.mean(axis=0), y.mean()
    c = x - mx
    beta = np.linalg.solve(c.T @ c + alpha * np.eye(x.shape[1]), c.T @ (y - my))
    return beta, float(my - mx @ beta)


def neighbours(train: np.ndarray, y: np.ndarray, test: np.ndarray, k: int = 5) -> np.ndarray:
    """Mean of the k nearest training values weighted by 1/distance; an exact match takes all weight."""
    out = np.empty(len(test))
    for lo in range(0, len(test), 256):
        d = np.sqrt(((test[lo : lo + 256, None, :] - train[None]) ** 2).sum(axis=2))
        near = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
        dist = np.take_along_axis(d, near, axis=1)
        w = np.where((dist == 0).any(axis=1, keepdims=True), (dist == 0).astype(float), 1 / np.maximum(dist, 1e-300))
        out[lo : lo + 256] = (w * y[near]).sum(axis=1) / w.sum(axis=1)
    return out


def granger_gain(y: np.ndarray, x: np.ndarray, lags: int = 3, kind: str = "linear", folds: int = 5) -> dict[str, float]:
    """RMSE of predicting y from its own lags, and from its and the sources' lags, over expanding folds."""
    x = x.reshape(len(y), -1)
    n = len(y) - lags
    size = n // (folds + 1)
    if size < 1:
        return {"rmse_uni": float("nan"), "rmse_bi": float("nan"), "gain": 0.0}
    own = np.column_stack([y[k : k + n] for k in range(lags)])
    both = np.column_stack([own, *[x[k : k + n] for k in range(lags)]])
    target = y[lags:]
    mse = {"uni": [], "bi": []}
    for f in range(folds):
        a = n - (folds - f) * size
        train, test = slice(0, a), slice(a, a + size)
        for name, m in (("uni", own), ("bi", both)):
            if kind == "linear":
                beta, cut = ridge(m[train], target[train])
                said = m[test] @ beta + cut
            else:
                said = neighbours(m[train], target[train], m[test])
            mse[name].append(float(((target[test] - said) ** 2).mean()))
    uni, bi = math.sqrt(np.mean(mse["uni"])), math.sqrt(np.mean(mse["bi"]))
    return {"rmse_uni": uni, "rmse_bi": bi, "gain": 0.0 if uni == 0 else max(0.0, 1 - bi / uni)}


def nearest_vectors(target: np.ndarray, dim: int, tau: int) -> np.ndarray:
    """Row numbers of the dim + 1 nearest other delay vectors of each delay vector; ties by position."""
    n = len(target) - (dim - 1) * tau
    vectors = np.column_stack([target[k * tau : n + k * tau] for k in range(dim)])
    near = np.empty((n, min(dim + 1, n - 1)), int)
    for lo in range(0, n, 256):
        d = ((vectors[lo : lo + 256, None, :] - vectors[None]) ** 2).sum(axis=2)
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        near[lo : lo + 256] = np.argsort(d, axis=1, kind="stable")[:, : near.shape[1]]
    return near


def cross_map(source: np.ndarray, target: np.ndarray, dim: int = 3, tau: int = 1, near: np.ndarray | None = None) -> float:
    """Correlation of the source with its mean over the dim + 1 nearest delay vectors of the target; 0 if negative or too short.

    near: nearest_vectors of the target, if known already; it doesn't depend on the source.
    """
    if len(target) < dim * tau + 5:
        return 0.0
    values = source[(dim - 1) * tau :]
    said = values[nearest_vectors(target, dim, tau) if near is None else near].mean(axis=1)
    if values.std() == 0 or said.std() == 0:
        return 0.0
    return max(0.0, float(np.corrcoef(values, said)[0, 1]))


def phase_surrogates(x: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Series with x's spectrum and mean but random phases."""
    rng = np.random.default_rng(seed)
    f = np.fft.rfft(x)
    turned = f * np.exp(2j * np.pi * rng.random((count, len(f))))
    turned[:, 0] = f[0]
    if len(x) % 2 == 0:
        turned[:, -1] = f[-1]  # the highest frequency of an even length has no phase to turn
    return np.fft.irfft(turned, n=len(x), axis=1)


def cross_map_test(source: np.ndarray, target: np.ndarray, dim: int = 3, surrogates: int = 30, seed: int = 0, level: float = 0.05) -> dict[str, float]:
    """Score, share of surrogates of the source scoring at least as high, and whether the score beats their quantile."""
    near = nearest_vectors(target, dim, 1) if len(target) >= dim + 5 else None
    score = cross_map(source, target, dim, 1, near)
    others = np.array([cross_map(s, target, dim, 1, near) for s in phase_surrogates(source, surrogates, seed)])
    return {"score": score, "p": float((others >= score).mean()), "significant": bool(score > np.quantile(others, 1 - level))}


def sample_entropy(x: np.ndarray, m: int = 2, ratio: float = 0.2) -> float:
    """-ln(A/B): of the pairs of templates of m values that lie within ratio population deviations, those that still do with
    one value more. NaN without such pairs. All pairs are compared, in blocks of rows."""
    n = len(x) - m
    if n < 2:
        return float("nan")
    r = ratio * x.std()
    vectors = np.column_stack([x[k : n + k] for k in range(m + 1)])
    short = longer = 0
    for lo in range(0, n, 256):
        near = np.abs(vectors[lo : lo + 256, None, :] - vectors[None, lo:, :]) <= r
        later = np.arange(lo, n)[None, :] > np.arange(lo, min(lo + 256, n))[:, None]
        close = near[:, :, :m].all(axis=2) & later
        short += int(close.sum())
        longer += int((close & near[:, :, m]).sum())
    return -math.log(longer / short) if short and longer else float("nan")
