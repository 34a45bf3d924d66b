import numpy as np

from tidemark.kernels import hmm
from tidemark.operators import forecaster, pipeline


def rounds_used(monkeypatch, call):
    """Limits of the EM fits that call makes."""
    seen, fit = [], hmm.fit_hmm
    monkeypatch.setattr(hmm, "fit_hmm", lambda x, k, rounds=fit.__defaults__[0], **more: seen.append(rounds) or fit(x, k, rounds, **more))
    call()
    return set(seen)


def test_em_limits_are_the_references(monkeypatch):
    g = np.random.default_rng(0)
    prices = 100 * np.exp(np.cumsum(g.normal(0, 0.01, 150)))
    assert rounds_used(monkeypatch, lambda: pipeline.regime_of(prices)) == {200}
    assert rounds_used(monkeypatch, lambda: hmm.choose_states(np.diff(np.log(prices)), 2)) == {100}


def test_panel_has_a_hundred_trees(spark, monkeypatch):
    seen, regressor = [], forecaster.GBTRegressor
    monkeypatch.setattr(forecaster, "GBTRegressor", lambda **named: seen.append(named["maxIter"]) or regressor(**named | {"maxIter": 2}))
    rows = [(f"e{k % 2}", f"q{k}", name, float(k)) for k in range(12) for name in ("input", "y")]
    predictions, _ = forecaster.fit_panel(spark.createDataFrame(rows, "entity string, quarter string, name string, value double"), ["input"], "y")
    assert predictions.count() == 12 and seen == [100]
