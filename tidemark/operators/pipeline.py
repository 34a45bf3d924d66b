"""Pipelines: characteristics, choice, fit and forecast of every series, walk-forward with models, and the whole analysis."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.series import by_series
from tidemark.kernels import hmm, regression, state_space
from tidemark.operators import estimators, ordered
from tidemark.operators.backtest import pipeline_choice

#: Steps of the four pipelines: seasonal filter or not, and the level of the state-space model.
PIPELINES = {"conservative": (True, "local linear trend"), "aggressive": (False, "local linear trend"), "crisis": (False, "local level"), "trend_following": (False, "smooth trend")}
SHORT = 20
#: Origins of a series that are fitted in one call.
ORIGINS_PER_CALL = 32


def characteristics(series: DataFrame) -> DataFrame:
    """series_id, n, slope, r2, outliers, nsr, lag, strength, p, d, stationary: what the choice of a pipeline looks at."""
    acf = ordered.autocorrelation(series, 40)
    d = estimators.least_order(series).where("chosen").select("series_id", "d")
    n = series.where("value is not null").groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        n.join(ordered.trend_and_noise(series), "series_id", "left").join(ordered.noise_to_signal(series), "series_id", "left").join(ordered.seasonality(acf), "series_id", "left")
        .join(ordered.autocorrelation_strength(acf), "series_id", "left").join(estimators.dickey_fuller(series).select("series_id", "p"), "series_id", "left").join(d, "series_id", "left")
        .withColumn("stationary", (F.col("n") < SHORT) | F.coalesce(F.col("p") <= 0.05, F.lit(False)))
    )


def choose(facts: DataFrame) -> DataFrame:
    """Adds pipeline and reason; needs regime, stationary, strength, d."""
    p = pipeline_choice(F.col("regime"), F.coalesce("stationary", F.lit(True)), F.coalesce("strength", F.lit(0.0)))
    reason = (
        F.when(p == "crisis", "crisis regime: the most robust pipeline")
        .when(p == "aggressive", F.concat(F.lit("not stationary; least order of differencing "), F.format_number(F.coalesce("d", F.lit(1.0)), 2)))
        .when(p == "trend_following", F.concat(F.lit("strong autocorrelation of "), F.format_number("strength", 2))).otherwise("nothing stands out")
    )
    return facts.withColumn("pipeline", p).withColumn("reason", reason)


def forecast_chosen(series: DataFrame, chosen: DataFrame, steps: int = 7, confidence: float = 0.95, period: int = 7) -> DataFrame:
    """series_id, pipeline, step, forecast, lower, upper, price: every series by its own pipeline (column pipeline of chosen)."""

    def one(_: str, rows: pd.DataFrame) -> pd.DataFrame:
        y, name = rows["value"].to_numpy(), rows["pipeline"].iloc[0]
        f = forecast_array(y, name, steps, confidence, period)
        return pd.DataFrame({"pipeline": name, "step": range(1, steps + 1), "forecast": f[:, 0], "lower": f[:, 1], "upper": f[:, 2], "price": y[-1]})

    joined = series.where("value is not null").join(chosen.select("series_id", "pipeline"), "series_id")
    return estimators.per_series(joined, one, "pipeline string, step int, forecast double, lower double, upper double, price double")


def forecast_array(y: np.ndarray, name: str, steps: int, confidence: float = 0.95, period: int = 7) -> np.ndarray:
    """Rows of forecast, lower, upper by one pipeline; persistence with 5 % bands if there are too few values."""
    if len(y) < SHORT:
        return np.tile([y[-1], y[-1] * 0.95, y[-1] * 1.05], (steps, 1))
    filtered, level = PIPELINES[name]
    if filtered and len(y) >= 2 * period:
        y = estimators.filter_array(y, period)[0]
    return state_space.fit(y, level).forecast(steps, confidence)


def walk_forward(series: DataFrame, horizon: int = 7, step: int = 7, min_history: int = 120, against: str | None = None) -> DataFrame:
    """series_id, origin, price, actual, forecast, lower, upper, regime, pipeline: refitted at every origin.

    against: name of a pipeline that is fitted at the same origins too, its forecast in the column against (else NULL).

    Origins lie step days apart, from the first day with min_history rows on. Blocks of a series' origins are spread over
    tasks, each with the history up to its last origin and the horizon after it.
    """
    whole = W.partitionBy("series_id")
    rows = series.where("value is not null").select("series_id", "ts", "value").withColumn("pos", F.row_number().over(by_series()))
    rows = rows.withColumn("first", F.min(F.when(F.col("pos") == min_history, F.col("ts"))).over(whole)).withColumn("days", F.datediff(F.max("ts").over(whole), "first")).where("days > 0")
    length = ORIGINS_PER_CALL * step
    rows = rows.withColumn("final", F.expr(f"(days - 1) div {length}"))
    # The first block whose last origin's horizon reaches the row; all later ones have it in their history.
    reach = F.ceil((F.datediff("ts", "first") + step - horizon) / length) - 1
    rows = rows.withColumn("block", F.explode(F.sequence(F.least("final", F.greatest(F.lit(0).cast("long"), reach)), "final")))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", kind="stable")
        y, day, first = rows["value"].to_numpy(), pd.to_datetime(rows["ts"]).to_numpy(), pd.Timestamp(rows["first"].iloc[0])
        begin = int(key[1]) * length
        out = []
        for after in range(begin, min(begin + length, int(rows["days"].iloc[0])), step):
            origin = (first + pd.Timedelta(days=after)).to_datetime64()
            k = int(np.searchsorted(day, origin, side="right"))
            j = int(np.searchsorted(day, origin + np.timedelta64(horizon, "D"), side="right"))
            if j <= k:
                continue
            past = y[:k]
            regime = regime_of(past)
            name = choice_of(past, regime)
            f = forecast_array(past, name, horizon)[-1]
            other = None if against is None else f[0] if against == name else forecast_array(past, against, horizon)[-1, 0]
            out.append((key[0], pd.Timestamp(origin).date(), past[-1], y[j - 1], *f, regime, name, other))
        return pd.DataFrame(out, columns=["series_id", "origin", "price", "actual", "forecast", "lower", "upper", "regime", "pipeline", "against"])

    columns = "series_id string, origin date, price double, actual double, forecast double, lower double, upper double, regime string, pipeline string, against double"
    blocks = estimators.spread(rows.select("series_id", "block", "ts", "value", "first", "days"), "series_id", "block")
    return blocks.groupBy("series_id", "block").applyInPandas(run, columns)


def regime_of(prices: np.ndarray) -> str:
    """Name of the hidden state at the end of the prices; unknown under 60 values or where a price is not positive."""
    if len(prices) < 60 or (prices <= 0).any():
        return "unknown"
    r = np.diff(np.log(prices))
    model, _ = hmm.fit_hmm(r, 4)
    state = int(model.forward_backward(r)[0][-1].argmax())
    calm = "bull" if model.mean[0] > 0 else "sideways"
    second = "sideways" if calm == "bull" else ("bull" if model.mean[1] > 0 else "bear")
    wild = "crisis" if model.mean[3] < 0 else "bear"
    third = next(n for n in ("bear", "sideways", "bull", "crisis") if n not in (calm, second, wild))
    return (calm, second, third, wild)[state]


def choice_of(prices: np.ndarray, regime: str) -> str:
    """The pipeline for one history."""
    if regime == "crisis":
        return "crisis"
    if regression.adf(prices)["p"] > 0.05:
        return "aggressive"
    c = prices - prices.mean()
    strength = np.mean([abs(float(c[k:] @ c[:-k]) / float(c @ c)) for k in range(1, 6)]) if c.any() else 0.0
    return "trend_following" if strength > 0.3 else "conservative"
