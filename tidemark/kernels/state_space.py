"""Unobserved-components models: batched Kalman filter, smoother, forecasts and likelihood search.

The filter runs all candidate variances of a search round at once, so one pass over time serves a whole round.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np

LEVELS = ("local level", "random walk with drift", "local linear trend", "smooth trend", "fixed intercept")
DIFFUSE = 1e6


@dataclass
class Model:
    """Observation row z, transition t, per state which variance drives it (-1: none), and the number of variances.

    Variance 0 is that of the observation (absent if noiseless); the others follow.
    """

    z: np.ndarray
    t: np.ndarray
    drives: list[int]
    variances: int
    noiseless: bool
    parts: dict[str, slice]


def build(level: str = "local linear trend", seasonal: int | None = None, cycle: float | None = None) -> Model:
    """The model of a level kind, with dummy seasonals of a period and a damped cycle of a period, if asked for."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}; one of {', '.join(LEVELS)}")
    blocks: list[tuple[str, np.ndarray, list[float], list[int]]] = []
    k = 1
    if level == "local level":
        blocks.append(("level", np.eye(1), [1.0], [k]))
        k += 1
    elif level == "fixed intercept":
        blocks.append(("level", np.eye(1), [1.0], [-1]))
    elif level == "random walk with drift":
        blocks.append(("level", np.array([[1.0, 1.0], [0.0, 1.0]]), [1.0, 0.0], [k, -1]))
        k += 1
    else:
        smooth = level == "smooth trend"
        blocks.append(("level", np.array([[1.0, 1.0], [0.0, 1.0]]), [1.0, 0.0], [-1 if smooth else k, k if smooth else k + 1]))
        k += 1 if smooth else 2
    if seasonal and seasonal > 1:
        m = seasonal - 1
        t = np.zeros((m, m))
        t[0] = -1
        t[np.arange(1, m), np.arange(m - 1)] = 1
        blocks.append(("seasonal", t, [1.0] + [0.0] * (m - 1), [k] + [-1] * (m - 1)))
        k += 1
    if cycle:
        a = 2 * np.pi / cycle
        blocks.append(("cycle", 0.95 * np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]), [1.0, 0.0], [k, k]))
        k += 1
    size = sum(len(b[2]) for b in blocks)
    t, z, drives, parts, at = np.zeros((size, size)), np.zeros(size), [], {}, 0
    for name, block, row, drive in blocks:
        m = len(row)
        t[at : at + m, at : at + m] = block
        z[at : at + m] = row
        drives += drive
        parts[name] = slice(at, at + m)
        at += m
    return Model(z, t, drives, k, level == "random walk with drift", parts)


def _noise(model: Model, variances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observation variance (batch) and state covariance (batch, m, m)."""
    q = np.zeros((len(variances), len(model.drives), len(model.drives)))
    for i, k in enumerate(model.drives):
        if k >= 0:
            q[:, i, i] = variances[:, k]
    return (np.zeros(len(variances)) if model.noiseless else variances[:, 0]), q


def run_filter(model: Model, y: np.ndarray, variances: np.ndarray, keep: bool = False) -> dict[str, np.ndarray]:
    """Filter y (NaN: missing) under each row of variances; log-likelihood, and for one row the whole path."""
    h, q = _noise(model, variances)
    batch, m = len(variances), len(model.z)
    a, p = np.zeros((batch, m)), np.tile(np.eye(m) * DIFFUSE, (batch, 1, 1))
    total = np.zeros(batch)
    diffuse_left = m
    path: dict[str, list] = {"a": [], "p": [], "af": [], "pf": [], "v": [], "f": []}
    z, t = model.z, model.t
    for value in y:
        if keep:
            path["a"].append(a[0].copy())
            path["p"].append(p[0].copy())
        pz = p @ z
        f = pz @ z + h
        v = value - a @ z
        if value == value:
            gain = pz / f[:, None]
            af, pf = a + gain * v[:, None], p - gain[:, :, None] * pz[:, None, :]
            if diffuse_left > 0:
                diffuse_left -= 1  # the first observations only place the states
            else:
                total -= 0.5 * (np.log(2 * np.pi * f) + v * v / f)
        else:
            af, pf = a, p
        if keep:
            for name, x in (("af", af), ("pf", pf), ("v", v), ("f", f)):
                path[name].append(x[0].copy())
        a, p = af @ t.T, t @ pf @ t.T + q
    out = {"loglik": total}
    if keep:
        out |= {k: np.array(x) for k, x in path.items()} | {"next_a": a[0], "next_p": p[0]}
    return out


def fit_variances(model: Model, y: np.ndarray, rounds: int = 7, batch: int = 24, seed: int = 0) -> tuple[np.ndarray, float]:
    """Variances of highest likelihood on a log scale: random search whose radius shrinks around the best so far."""
    rng = np.random.default_rng(seed)
    scale = max(float(np.nanvar(np.diff(y[np.isfinite(y)]))) if np.isfinite(y).sum() > 2 else 1.0, 1e-8)
    centre = np.full(model.variances, np.log(scale / 2))
    best = -np.inf
    for r in range(rounds):
        radius = 3.0 * 0.55**r
        tried = np.vstack([centre, centre + rng.normal(0, radius, (batch - 1, model.variances))])
        tried = np.clip(tried, np.log(scale) - 16, np.log(scale) + 8)
        loglik = run_filter(model, y, np.exp(tried))["loglik"]
        loglik = np.where(np.isfinite(loglik), loglik, -np.inf)
        k = int(loglik.argmax())
        if loglik[k] > best:
            best, centre = float(loglik[k]), tried[k]
    return np.exp(centre), best


@dataclass
class Fit:
    """A fitted model on standardised data, with what is needed to give results on the original scale."""

    model: Model
    variances: np.ndarray
    loglik: float
    mean: float
    scale: float
    y: np.ndarray
    path: dict[str, np.ndarray]

    @property
    def aic(self) -> float:
        used = {k for k in self.model.drives if k >= 0} | (set() if self.model.noiseless else {0})
        return 2 * len(used) - 2 * self.loglik

    def smoothed_states(self) -> np.ndarray:
        """States given all observations, by the backward pass."""
        n, t = len(self.y), self.model.t
        out = self.path["af"].copy()
        p = self.path["pf"].copy()
        for i in range(n - 2, -1, -1):
            ahead = self.path["p"][i + 1]
            gain = self.path["pf"][i] @ t.T @ np.linalg.pinv(ahead, hermitian=True)
            out[i] = out[i] + gain @ (out[i + 1] - self.path["a"][i + 1])
            p[i] = p[i] + gain @ (p[i + 1] - ahead) @ gain.T
        return out

    def smooth(self) -> np.ndarray:
        """Signal given all observations."""
        return self.smoothed_states() @ self.model.z * self.scale + self.mean

    def predicted(self) -> np.ndarray:
        """One-step predictions."""
        return self.path["a"] @ self.model.z * self.scale + self.mean

    def residuals(self) -> np.ndarray:
        """Observations minus one-step predictions."""
        return self.y * self.scale + self.mean - self.predicted()

    def components(self) -> dict[str, np.ndarray]:
        """Level (with the mean), trend, seasonal and cycle on the original scale."""
        states, out = self.smoothed_states(), {}
        for name, where in self.model.parts.items():
            out[name] = states[:, where.start] * self.scale + (self.mean if name == "level" else 0.0)
            if name == "level" and where.stop - where.start == 2:
                out["trend"] = states[:, where.start + 1] * self.scale
        return out

    def forecast(self, steps: int, confidence: float = 0.95) -> np.ndarray:
        """Rows of forecast, lower, upper."""
        z = NormalDist().inv_cdf(0.5 + confidence / 2)
        h, q = _noise(self.model, self.variances[None])
        a, p = self.path["next_a"], self.path["next_p"]
        rows = []
        for _ in range(steps):
            mean, sd = a @ self.model.z, np.sqrt(max(self.model.z @ p @ self.model.z + h[0], 0))
            rows.append([mean, mean - z * sd, mean + z * sd])
            a, p = self.model.t @ a, self.model.t @ p @ self.model.t.T + q[0]
        return np.array(rows) * self.scale + self.mean


def fit(y: np.ndarray, level: str = "local linear trend", seasonal: int | None = None, cycle: float | None = None, seed: int = 0) -> Fit:
    """Fit by maximum likelihood on standardised data; a constant series keeps a scale of 1."""
    y = np.asarray(y, float)
    known = y[np.isfinite(y)]
    mean = float(known.mean()) if len(known) else 0.0
    scale = float(known.std(ddof=1)) if len(known) > 1 else 1.0
    scale = scale if scale > 0 else 1.0
    s = (y - mean) / scale
    model = build(level, seasonal, cycle)
    variances, loglik = fit_variances(model, s, seed=seed)
    return Fit(model, variances, loglik, mean, scale, s, run_filter(model, s, variances[None], keep=True))
