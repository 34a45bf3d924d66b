"""Invariants of the numeric kernels on seeded series."""

import numpy as np
import pytest

from tidemark.functions.special import chi2_sf
from tidemark.kernels import arma, chained, hmm, regression, residuals, state_space, stl
from tidemark.operators.fracdiff import ffd_weights, frac_diff_arrays

rng = np.random.default_rng(42)
WALK = np.cumsum(rng.normal(size=1000))
AR1 = np.zeros(1000)
for i in range(1, 1000):
    AR1[i] = 0.5 * AR1[i - 1] + rng.normal()


def test_unit_root_separates():
    assert regression.adf(WALK)["p"] > 0.1 and regression.adf(AR1)["p"] < 0.01
    assert abs(regression.adf_p(-2.86) - 0.05) < 0.001
    assert regression.adf(np.ones(50))["p"] == 1.0 and regression.adf(np.arange(5.0))["p"] == 1.0


def test_chi_square_tail():
    assert abs(chi2_sf(3.841459, 1) - 0.05) < 1e-6 and abs(chi2_sf(18.307, 10) - 0.05) < 1e-4
    assert all(abs(chi2_sf(x, 4) - np.exp(-x / 2) * (1 + x / 2)) < 1e-12 for x in (0.5, 3.0, 20.0)) and chi2_sf(0, 3) == 1.0


def test_fractional_differencing():
    assert ffd_weights(1.0, 1e-5) == [-1.0, 1.0] and np.allclose(frac_diff_arrays(WALK, 1.0), np.diff(WALK))
    with pytest.raises(ValueError):
        ffd_weights(0.5, 0)


def test_decomposition_adds_up():
    y = np.linspace(0, 5, 240) + 2 * np.sin(np.arange(240) * 2 * np.pi / 12) + 0.3 * rng.normal(size=240)
    trend, season, rest = stl.decompose(y, 12)
    assert np.allclose(trend + season + rest, y) and abs(season.std() - np.sqrt(2)) < 0.1 and rest.std() < 0.35
    y[50] += 30
    assert abs(stl.decompose(y, 12)[0][50] - np.linspace(0, 5, 240)[50]) < 1  # an outlier does not bend the trend
    assert np.allclose(sum(stl.decompose(np.arange(5.0), 12)), np.arange(5.0))


def test_kalman():
    truth = np.linspace(0, 10, 300)
    y = truth + rng.normal(size=300)
    fit = state_space.fit(y, "local linear trend")
    assert ((fit.smooth() - truth) ** 2).mean() < ((y - truth) ** 2).mean() / 5
    f = fit.forecast(10)
    width = f[:, 2] - f[:, 1]
    assert (np.diff(width) >= -1e-9).all() and abs(f[0, 0] - 10) < 1.5
    assert (fit.forecast(3, 0.99)[:, 2] > f[:3, 2]).all()
    for level in state_space.LEVELS:
        assert np.isfinite(state_space.fit(y, level).loglik)
    with pytest.raises(ValueError):
        state_space.build("none")
    y[10:20] = np.nan
    assert np.isfinite(state_space.fit(y).smooth()).all()
    assert np.isfinite(state_space.fit(np.ones(30)).forecast(2)).all()


def test_hidden_states():
    x = np.concatenate([rng.normal(0, 0.5, 200), rng.normal(5, 0.6, 100), rng.normal(0, 0.5, 200)])
    model, _ = hmm.fit_hmm(x, 2)
    path = model.path(x)
    truth = np.repeat([0, 1, 0], [200, 100, 200])
    assert max((path == truth).mean(), (path != truth).mean()) > 0.95
    gamma = model.forward_backward(x)[0]
    assert np.allclose(gamma.sum(axis=1), 1) and np.allclose(model.move.sum(axis=1), 1) and model.var[0] <= model.var[1]
    assert 0 <= hmm.leaving_risk(model.move, 0) <= 1


def test_orders():
    order, model = arma.best_seasonal(AR1, 7)
    assert order[0] >= 1 and abs(model.beta[0] - 0.5) < 0.1 and order != (0, 0, 0, 0)
    assert arma.best_arima(WALK)[0][1] == 1
    f = arma.forecast_arima(WALK, *arma.best_arima(WALK), 5)
    assert len(f) == 5 and abs(f[0] - WALK[-1]) < 5
    assert arma.fit_arma(np.arange(4.0), 2, 2) is None


def test_chained_imputation():
    x = rng.normal(size=(100, 3))
    x[:, 2] = 2 * x[:, 0] - x[:, 1] + 0.05 * rng.normal(size=100)
    y = x.copy()
    y[:20, 2] = np.nan
    z = chained.impute(y)
    assert np.abs(z[:20, 2] - x[:20, 2]).max() < 0.3 and np.array_equal(z[20:], x[20:])
    assert chained.impute(np.full((3, 2), np.nan)).tolist() == [[0, 0]] * 3


def test_residual_tests():
    noise = np.random.default_rng(1).normal(size=400)
    assert residuals.shapiro(noise)[1] > 0.05 and residuals.shapiro(np.exp(noise))[1] < 0.001
    p = [residuals.shapiro(np.random.default_rng(s).normal(size=40))[1] for s in range(200)]
    assert 0.02 < np.mean(np.array(p) < 0.1) < 0.2
    assert residuals.spectrum_variation(noise) < 1.2 < residuals.spectrum_variation(WALK)
    p = [residuals.ljung_box(np.random.default_rng(s).normal(size=300), 10)[1] for s in range(200)]
    assert 0.05 < np.mean(np.array(p) < 0.1) < 0.17 and residuals.ljung_box(AR1, 10)[1] < 0.001
    assert np.isnan(residuals.shapiro(np.ones(10))[0])


def test_causality():
    a, b = np.full(500, 0.4), np.full(500, 0.2)
    for i in range(499):
        a[i + 1] = min(0.999, max(0.001, a[i] * (3.8 - 3.8 * a[i])))
        b[i + 1] = min(0.999, max(0.001, b[i] * (3.5 - 3.5 * b[i] - 0.3 * a[i])))
    assert regression.cross_map_test(a, b)["score"] > 0.3 and regression.cross_map(a[:5], b[:5]) == 0
    x, y = np.zeros(300), np.zeros(300)
    for i in range(1, 300):
        x[i] = 0.8 * x[i - 1] + 0.3 * rng.normal()
        y[i] = 0.5 * y[i - 1] + 0.4 * x[i - 1] + 0.2 * rng.normal()
    assert regression.granger_gain(y, x)["gain"] > regression.granger_gain(x, y)["gain"] + 0.05
    assert regression.granger_gain(y, x, kind="knn")["gain"] > 0
    s = regression.phase_surrogates(x, 5, 0)
    assert np.allclose(s.mean(axis=1), x.mean()) and np.allclose(np.abs(np.fft.rfft(s[0])), np.abs(np.fft.rfft(x)))


def test_sample_entropy_counts_all_pairs():
    import math

    import numpy as np

    from tidemark.kernels.regression import sample_entropy

    x = np.random.default_rng(2).normal(size=600).cumsum()
    r = 0.2 * x.std()
    near = lambda i, j, k: all(abs(x[i + d] - x[j + d]) <= r for d in range(k))
    pairs = [(i, j) for i in range(598) for j in range(i + 1, 598) if near(i, j, 2)]
    assert abs(sample_entropy(x) + math.log(sum(near(i, j, 3) for i, j in pairs) / len(pairs))) < 1e-12
    assert math.isnan(sample_entropy(np.arange(2.0)))
