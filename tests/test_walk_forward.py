import datetime as dt

import numpy as np
import pytest

from tidemark.operators import pipeline
from tidemark.plans import registry

D0 = dt.date(2020, 1, 1)
SCHEMA = "series_id string, ts date, value double"


def prices(seed, n):
    """(day number, price) of about nine days in ten."""
    g = np.random.default_rng(seed)
    v = 100 * np.exp(np.cumsum(g.normal(0, 0.01, n)))
    return [(i, float(x)) for i, x in enumerate(v) if g.random() < 0.9]


def brute(rows, step, horizon=7, least=120):
    """Day of origin, past values and the value at the horizon, by loops."""
    for origin in range(rows[least - 1][0], rows[-1][0], step):
        past, later = [v for i, v in rows if i <= origin], [v for i, v in rows if origin < i <= origin + horizon]
        if later:
            yield D0 + dt.timedelta(days=origin), np.array(past), later[-1]


@pytest.fixture(scope="module")
def history():
    return {"a": prices(1, 420), "b": prices(2, 180), "c": prices(3, 100)}


@pytest.fixture(scope="module")
def folder(spark, history, tmp_path_factory):
    path = tmp_path_factory.mktemp("walk")
    bars = [(s, dt.datetime.combine(D0, dt.time()) + dt.timedelta(days=i), v, dt.datetime(2024, 1, 1), 1) for s, rows in history.items() for i, v in rows]
    spark.createDataFrame(bars, "symbol string, ts timestamp, close double, ingested_at timestamp, bar_id long").write.parquet(str(path / "ohlcv.parquet"))
    return str(path)


def test_every_origin_is_fitted_on_its_own_history(spark, history):
    s = spark.createDataFrame([(k, D0 + dt.timedelta(days=i), v) for k, rows in history.items() if k != "a" for i, v in rows] + [("a", D0 + dt.timedelta(days=i), v) for i, v in history["a"]], SCHEMA)
    got = {(r.series_id, r.origin): r for r in pipeline.walk_forward(s).collect()}
    want = {(k, origin): (past, actual) for k, rows in history.items() if len(rows) > 120 for origin, past, actual in brute(rows, 7)}
    assert set(got) == set(want) and len({k for k, _ in want}) == 2
    for key, (past, actual) in want.items():
        r = got[key]
        assert (r.price, r.actual, r.regime) == (past[-1], actual, pipeline.regime_of(past)) and r.pipeline == pipeline.choice_of(past, r.regime)
        assert np.allclose([r.forecast, r.lower, r.upper], pipeline.forecast_array(past, r.pipeline, 7)[-1])


def test_models_are_walked_weekly(spark, history, folder):
    got = {r.series_id: r.n for r in registry.queries()["walk_forward_models"](spark, folder).collect()}
    assert got == {k: sum(1 for _ in brute(rows, 7)) for k, rows in history.items() if len(rows) > 120}


def test_advantage_is_over_the_conservative_pipeline(spark, history, folder):
    got = {r.series_id: r for r in registry.queries()["pipeline_advantage"](spark, folder).collect()}
    assert set(got) == {"a", "b"}
    for key, r in got.items():
        own, other = [], []
        for _, past, actual in brute(history[key], 14):
            name = pipeline.choice_of(past, pipeline.regime_of(past))
            own.append(abs(pipeline.forecast_array(past, name, 7)[-1, 0] - actual))
            other.append(abs(pipeline.forecast_array(past, "conservative", 7)[-1, 0] - actual))
        assert abs(r.mae - np.mean(own)) < 1e-3 and abs(r.conservative_mae - np.mean(other)) < 1e-3
        assert abs(r.advantage - 100 * (np.mean(other) - np.mean(own)) / np.mean(other)) < 1e-3
