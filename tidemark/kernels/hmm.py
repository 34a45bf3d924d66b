"""Gaussian hidden Markov model on one variable: EM, posteriors, most likely path, choice of the number of states."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Hmm:
    """Start and transition probabilities, means and variances; states in order of rising deviation."""

    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return -0.5 * (np.log(2 * np.pi * self.var)[None] + (x[:, None] - self.mean[None]) ** 2 / self.var[None])

    def forward_backward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Posteriors (n, k), expected transitions (k, k) and log-likelihood, scaled at every step."""
        log_b = self.log_density(x)
        top = log_b.max(axis=1, keepdims=True)
        b = np.exp(log_b - top)
        n, k = b.shape
        alpha, scale, beta = np.empty((n, k)), np.empty(n), np.empty((n, k))
        a = self.start * b[0]
        for i in range(n):
            if i:
                a = (alpha[i - 1] @ self.move) * b[i]
            scale[i] = max(a.sum(), 1e-300)
            alpha[i] = a / scale[i]
        beta[-1] = 1
        for i in range(n - 2, -1, -1):
            beta[i] = self.move @ (b[i + 1] * beta[i + 1]) / scale[i + 1]
        gamma = alpha * beta
        gamma /= np.maximum(gamma.sum(axis=1, keepdims=True), 1e-300)
        xi = self.move * (alpha[:-1].T @ (b[1:] * beta[1:] / scale[1:, None]))
        return gamma, xi, float((np.log(scale) + top[:, 0]).sum())

    def path(self, x: np.ndarray) -> np.ndarray:
        """Most likely states."""
        log_b, log_move = self.log_density(x), np.log(np.maximum(self.move, 1e-300))
        score = np.log(np.maximum(self.start, 1e-300)) + log_b[0]
        back = np.zeros(log_b.shape, int)
        for i in range(1, len(x)):
            options = score[:, None] + log_move
            back[i] = options.argmax(axis=0)
            score = options.max(axis=0) + log_b[i]
        out = np.empty(len(x), int)
        out[-1] = score.argmax()
        for i in range(len(x) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out

    def ordered(self) -> Hmm:
        """Means, variances, start and both sides of the transitions in order of rising variance."""
        o = np.argsort(self.var, kind="stable")
        return Hmm(self.start[o], self.move[np.ix_(o, o)], self.mean[o], self.var[o])


def fit_hmm(x: np.ndarray, states: int, rounds: int = 200, tolerance: float = 1e-4) -> tuple[Hmm, float]:
    """EM from a start that cuts the values by their distance from the median; variances stay above a thousandth of x's."""
    x = np.asarray(x, float)
    spread = max(float(x.var()), 1e-12)
    cut = np.argsort(np.argsort(np.abs(x - np.median(x)), kind="stable"), kind="stable") * states // max(len(x), 1)
    mean = np.array([x[cut == k].mean() if (cut == k).any() else x.mean() for k in range(states)])
    var = np.array([max(x[cut == k].var(), 1e-3 * spread) if (cut == k).any() else spread for k in range(states)])
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    model, before = Hmm(np.full(states, 1 / states), move, mean, var), -np.inf
    for _ in range(rounds):
        gamma, xi, loglik = model.forward_backward(x)
        mass = np.maximum(gamma.sum(axis=0), 1e-12)
        mean = gamma.T @ x / mass
        var = np.maximum((gamma * (x[:, None] - mean[None]) ** 2).sum(axis=0) / mass, 1e-3 * spread)
        move = (xi + 1e-6) / (xi + 1e-6).sum(axis=1, keepdims=True)
        model = Hmm(gamma[0], move, mean, var)
        if loglik - before < tolerance * abs(before if np.isfinite(before) else 1):
            break
        before = loglik
    return model.ordered(), loglik


def choose_states(x: np.ndarray, most: int = 5, folds: int = 5) -> dict[int, float]:
    """Mean held-out log-likelihood per value for 2..most states over expanding folds; short training parts are skipped."""
    size = len(x) // (folds + 1)
    out: dict[int, float] = {}
    for k in range(2, most + 1):
        scores = []
        for f in range(folds):
            a = len(x) - (folds - f) * size
            if size > 0 and a >= 10 * k:
                model, _ = fit_hmm(x[:a], k, rounds=100)
                scores.append(model.forward_backward(x[a : a + size])[2] / size)
        if scores:
            out[k] = float(np.mean(scores))
    return out


def leaving_risk(move: np.ndarray, state: int, steps: int = 14) -> float:
    """Probability of being elsewhere after some steps."""
    return float(1 - np.linalg.matrix_power(move, steps)[state, state])
