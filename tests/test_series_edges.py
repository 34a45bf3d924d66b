"""Empty, one-row, constant and gappy series through the operators, and kernels against their SQL siblings."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.kernels import regression
from tidemark.kernels import residuals as rs
from tidemark.operators import align, backtest, causality, diagnostics, estimators, fracdiff, ordered, pipeline, regimes
from tidemark.functions.series import parse_quarter

SCHEMA = "series_id string, ts date, value double"
D0 = dt.date(2020, 1, 1)


def series(spark, **data):
    rows = [(k, D0 + dt.timedelta(days=i), None if v is None else float(v)) for k, values in data.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return series(spark, one=[5], flat=[2] * 40, none=[None] * 5, gap=[1, None, 3, None, 5, 6, 7, 8])


CALLS = {
    "acf": lambda s: ordered.autocorrelation(s, 5), "lb": lambda s: ordered.ljung_box(ordered.autocorrelation(s, 3), 3), "nsr": ordered.noise_to_signal, "hurst": ordered.hurst_slope, "entropy": ordered.histogram_entropy,
    "sampen": ordered.sample_entropy, "drawdown": ordered.drawdown, "trend": ordered.trend_and_noise, "ffd": lambda s: fracdiff.frac_diff(s, 0.4, 1e-1), "quarters": lambda s: align.resample_quarters(s, "sum"), "aligned": align.aligned,
    "asfreq": align.every_day, "period": align.seasonal_period, "features": align.mixed_frequency_features, "held": backtest.held_values, "adf": estimators.dickey_fuller, "order": estimators.least_order,
    "stl": lambda s: estimators.seasonal_trend(s, 7), "sarima": lambda s: estimators.seasonal_arma(s, 7), "filter": lambda s: estimators.two_stage_filter(s, 7), "kalman": estimators.kalman, "forecast": lambda s: estimators.kalman_forecast(s, 2),
    "versus": estimators.kalman_against_arima, "hmm": estimators.hidden_regimes, "fold": estimators.fixed_local_level, "viterbi": estimators.fixed_viterbi, "check": diagnostics.pipeline_check, "facts": pipeline.characteristics, "walk": pipeline.walk_forward,
}


@pytest.mark.parametrize("name", sorted(CALLS))
def test_odd_series(odd, name):
    CALLS[name](odd).toPandas()
    assert len(CALLS[name](odd.limit(0)).toPandas()) == 0


def test_unknown_arguments(odd):
    for call in (lambda: align.resample_quarters(odd, "median"), lambda: align.aligned(odd, "H"), lambda: fracdiff.frac_diff(odd, -1)):
        with pytest.raises(ValueError):
            call()


def test_fractional_differencing_identities(spark):
    s = series(spark, a=np.cumsum(np.random.default_rng(0).normal(size=60)).tolist())
    v = [r.value for r in s.orderBy("ts").collect()]
    assert [r.value for r in fracdiff.frac_diff(s, 0).orderBy("ts").collect()] == v
    assert np.allclose([r.value for r in fracdiff.frac_diff(s, 1.0).orderBy("ts").collect()], np.diff(v))
    assert np.allclose([r.value for r in fracdiff.frac_diff(s, 0.4, 1e-2).orderBy("ts").collect()], fracdiff.frac_diff_arrays(np.array(v), 0.4, 1e-2))


def test_kernels_equal_expressions(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=80)
    s = series(spark, a=x.tolist())
    r = ordered.ljung_box(ordered.autocorrelation(s, 10), 10).collect()[0]
    q, p = rs.ljung_box(x, 10)
    assert abs(r.q - q) < 1e-9 and abs(r.p - p) < 1e-9
    y = np.cumsum(x)
    pairs = spark.createDataFrame([("a", D0 + dt.timedelta(days=i), float(a), float(b)) for i, (a, b) in enumerate(zip(y, x, strict=True))], "series_id string, ts date, y double, x double")
    assert abs(causality.cross_map_score(pairs).collect()[0].score - regression.cross_map(x, y)) < 1e-9
    gain, same = causality.granger_gain_one_lag(pairs).collect()[0], regression.granger_gain(y, x, 1)
    assert abs(gain.rmse_uni - same["rmse_uni"]) < 1e-9 and abs(gain.gain - same["gain"]) < 1e-9


def test_quarters(spark):
    texts = ["2020Q1", "2020 Q2", "2020-Q3", "2020-12-31", "2020Q5", "", None]
    got = [r.q for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(parse_quarter(F.col("t")).alias("q")).collect()]
    assert got == [dt.date(2020, 3, 31), dt.date(2020, 6, 30), dt.date(2020, 9, 30), dt.date(2020, 12, 31), None, None, None]


def test_state_names(spark):
    rows = [("a", 0, 0.1, 0.1), ("a", 1, 0.2, 0.2), ("a", 2, -0.1, 0.3), ("a", 3, -0.2, 0.4), ("b", 0, -0.1, 0.1), ("b", 1, 0.2, 0.2), ("b", 2, 0.1, 0.3), ("b", 3, 0.2, 0.4), ("c", 0, 1.0, 0.1), ("c", 1, -1.0, 0.2)]
    got = {(r.series_id, r.state): r["name"] for r in regimes.name_states(spark.createDataFrame(rows, "series_id string, state int, mean double, std double")).collect()}
    assert [got["a", k] for k in range(4)] == ["bull", "sideways", "bear", "crisis"] and [got["c", k] for k in range(2)] == ["bull", "bear"]
    assert [got["b", k] for k in range(4)] == ["sideways", "bull", "crisis", "bear"]


def test_backtest_against_loops(spark):
    g = np.random.default_rng(1)
    v = (100 * np.exp(np.cumsum(g.normal(0, 0.01, 300)))).tolist()
    keep = g.random(300) < 0.7
    s = spark.createDataFrame([("a", D0 + dt.timedelta(days=i), x) for i, x in enumerate(v) if keep[i]], SCHEMA)
    days = [i for i in range(300) if keep[i]]
    want = {}
    for o in range(0, 320, 7):
        past, later = [i for i in days if i <= o], [i for i in days if o < i <= o + 7]
        if len(past) >= 50 and later:
            want[D0 + dt.timedelta(days=o)] = (len(past), v[past[-1]], v[later[-1]])
    got = {r.origin: (r.history, r.price, r.actual) for r in backtest.origins_and_actuals(s, "2020-01-01", str(D0 + dt.timedelta(days=319)), 7, 7, 50).collect()}
    assert got == want
