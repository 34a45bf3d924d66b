import datetime as dt

import numpy as np

from tidemark.operators import estimators

D0 = dt.date(2020, 1, 1)


def brute_score(x, y, dim=3):
    """Cross map by loops over all delay vectors."""
    v = [y[i : i + dim] for i in range(len(y) - dim + 1)]
    said = []
    for i, a in enumerate(v):
        d = sorted((sum((p - q) ** 2 for p, q in zip(a, b, strict=True)), j) for j, b in enumerate(v) if j != i)
        said.append(np.mean([x[j + dim - 1] for _, j in d[: dim + 1]]))
    return max(0.0, np.corrcoef(x[dim - 1 :], said)[0, 1])


def brute_gain(y, x, lags=3, folds=5, alpha=1.0):
    """Gain of ridge regression with the source's lags over expanding folds, by the normal equations."""
    n = len(y) - lags
    size, target = n // (folds + 1), y[lags:]
    own = np.array([y[i : i + lags] for i in range(n)])
    both = np.array([[*y[i : i + lags], *x[i : i + lags]] for i in range(n)])
    errors = []
    for m in (own, both):
        mse = []
        for a in (n - (folds - f) * size for f in range(folds)):
            full = np.c_[np.ones(a), m[:a]]
            beta = np.linalg.solve(full.T @ full + alpha * np.diag([0.0] + [1.0] * m.shape[1]), full.T @ target[:a])
            mse.append(np.mean((target[a : a + size] - np.c_[np.ones(size), m[a : a + size]] @ beta) ** 2))
        errors.append(np.sqrt(np.mean(mse)))
    return max(0.0, 1 - errors[1] / errors[0])


def test_early_rows_count(spark):
    g = np.random.default_rng(7)
    x, y = g.normal(size=480), g.normal(size=480)
    y[1:80] += 3 * x[:79]  # x drives y in the first rows only
    pairs = spark.createDataFrame([("a", D0 + dt.timedelta(days=i), float(a), float(b)) for i, (a, b) in enumerate(zip(y, x, strict=True))], "series_id string, ts date, y double, x double")
    r = estimators.full_causality(pairs, horizons=(1,)).collect()[0]
    ahead, source = y[1:], x[:-1]
    assert abs(r.score - brute_score(source, ahead)) < 1e-9
    assert abs(r.linear_gain - brute_gain(ahead, source)) < 1e-9
    assert abs(brute_score(source, ahead) - brute_score(source[-399:], ahead[-399:])) > 1e-3
