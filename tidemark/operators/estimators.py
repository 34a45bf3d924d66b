"""Estimators per series: numpy kernels inside grouped Arrow batches, one series per call.

Input: series_id, ts, value unless said otherwise. A series is bounded by its calendar and goes to one call; any number of
series spread over the cluster. NULL and NaN values are left out. Series too short for an estimator give the result its
docstring names, never an error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.kernels import arma, chained, hmm, regression, state_space, stl
from tidemark.operators.fracdiff import frac_diff_arrays


def per_series(df: DataFrame, function: Callable[[str, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """function(series_id, rows in time order) for every series; its frame gets series_id in front."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = function(key[0], rows.sort_values("ts", kind="stable").reset_index(drop=True))
        out.insert(0, "series_id", key[0])
        return out

    return df.groupBy("series_id").applyInPandas(run, f"series_id string, {schema}")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df parted by keys into more tasks than its bytes ask for, for work that costs much a row."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism), *keys)


def _known(series: DataFrame) -> DataFrame:
    return series.where("value is not null and not isnan(value)").select("series_id", "ts", "value")


def dickey_fuller(series: DataFrame) -> DataFrame:
    """series_id, stat, p, lag, crit5; NaN and p = 1 for short or constant series."""

    def one(_: str, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([regression.adf(rows["value"].to_numpy())])[["stat", "p", "lag", "crit5"]]

    return per_series(_known(series), one, "stat double, p double, lag int, crit5 double")


def least_order(series: DataFrame, most: float = 1.0, steps: int = 11, threshold: float = 1e-2, min_points: int = 20) -> DataFrame:
    """series_id, d, stat, crit5, corr, chosen: every order of the grid and whether it is the least stationary one (else the greatest)."""

    def one(_: str, rows: pd.DataFrame) -> pd.DataFrame:
        y = rows["value"].to_numpy()
        out = []
        for d in np.linspace(0, most, steps):
            z = y if d == 0 else frac_diff_arrays(y, float(d), threshold)
            if len(z) < min_points:
                continue
            test = regression.adf(z)
            same = y[len(y) - len(z) :]
            corr = float(np.corrcoef(z, same)[0, 1]) if z.std() > 0 and same.std() > 0 else np.nan
            out.append((float(d), test["stat"], test["crit5"], corr))
        frame = pd.DataFrame(out, columns=["d", "stat", "crit5", "corr"])
        ok = np.flatnonzero(frame["stat"] < frame["crit5"])
        frame["chosen"] = False
        if len(frame):
            frame.loc[ok[0] if len(ok) else len(frame) - 1, "chosen"] = True
        return frame

    return per_series(_known(series), one, "d double, stat double, crit5 double, corr double, chosen boolean")


def seasonal_trend(series: DataFrame, period: int) -> DataFrame:
    """series_id, ts, value, trend, seasonal, rest, adding up to value."""

    def one(_: str, rows: pd.DataFrame) -> pd.DataFrame:
        t, s, r = stl.decompose(rows["value"].to_numpy(), period)
        return rows[["ts", "value"]].assign(trend=t, seasonal=s, rest=r)

    return per_series(_known(series), one, "ts date, value double, trend double, seasonal double, rest double")


def seasonal_arma(series: DataFrame, period: int) -> DataFrame:
    """series_id, p, q, sp, sq, aic of the best order; no row where no order fits the length."""

    def one(_: str, rows: pd.DataFrame) -> pd.DataFrame:
        best = arma.best_seasonal(rows["value"].to_numpy(), period)
        return pd.DataFrame([] if best is None else [(*best[0], best[1].aic)], columns=["p", "q", "sp", "sq", "aic"])

    return per_series(_known(series), one, "p int, q int, sp int, sq int, aic double")


def filter_array(y: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Filtered values and residuals: the decomposition's rest modelled by a seasonal ARMA, whose shocks are taken off.

    The first period rows are left as they are; so is a series whose rest no order fits.
    """
    _, _, rest = stl.decompose(y, period)
    best = arma.best_seasonal(rest, period)
    shocks = np.zeros(len(y)) if best is None else best[1].residuals.copy()
    shocks[: min(period, len(y))] = 0.0
    return y - shocks, shocks


def two_stage_filter(series: DataFrame, period: int) -> DataFrame:
    """series_id, ts, original, filtered, residual."""

    def one(_: str, rows: pd.DataFrame) -> pd.DataFrame:
        y = rows["value"].to_numpy()
        f, r = filter_array(y, period)
        return rows[["ts"]].assign(original=y, filtered=f, residual=r)

    return per_series(_known(series), one, "ts date, original double, filtered double, residual double")


def kalman(series: DataFrame, level: str = "local linear trend", seasonal: int | None = None, cycle: float | None = None) -> DataFrame:
    """series_id, ts, component, value in long form: smoothed, predicted, residual, level, trend, seasonal, cycle."""

    def one(_: str, rows: pd.DataFrame) -> pd.DataFrame:
        fit = state_space.fit(rows["value"].to_numpy(), level, seasonal, cycle)
        parts = {"smoothed": fit.smooth(), "predicted": fit.predicted(), "residual": fit.residuals(), **fit.components()}
        return pd.concat([rows[["ts"]].assign(component=k, value=v) for k, v in parts.items()], ignore_index=True)

    return per_series(_known(series), one, "ts date, component string, value double")


def kalman_summary(series: DataFrame, level: str = "local linear trend", seasonal: int | None = None) -> DataFrame:
    """series_id, n, loglik, aic, variances."""

    def one(_: str, rows: pd.DataFrame) -> pd.DataFrame:
        fit = state_space.fit(rows["value"].to_numpy(), level, seasonal)
        return pd.DataFrame({"n": [len(rows)], "loglik": [fit.loglik], "aic": [fit.aic], "variances": [fit.variances.tolist()]})

    return per_series(_known(series), one, "n long, loglik double, aic double, variances array<double>")


def kalman_forecast(series: DataFrame, steps: int, level: str = "local linear trend", confidence: float = 0.95, period: int | None = None) -> DataFrame:
    """series_id, step, ts, forecast, lower, upper, day by day after the series' last day; period: filter first."""

    def one(_: str, rows: pd.DataFrame) -> pd.DataFrame:
        y = rows["value"].to_numpy()
        if period and len(y) >= 2 * period:
            y = filter_array(y, period)[0]
        f = state_space.fit(y, level).forecast(steps, confidence)
        last = pd.Timestamp(rows["ts"].iloc[-1])
        return pd.DataFrame({"step": range(1, steps + 1), "ts": [(last + pd.Timedelta(days=k)).date() for k in range(1, steps + 1)], "forecast": f[:, 0], "lower": f[:, 1], "upper": f[:, 2]})

    return per_series(_known(series), one, "step int, ts date, forecast double, lower double, upper double")


def kalman_against_arima(series: DataFrame, holdout: int = 4) -> DataFrame:
    """series_id, kalman_rmse, kalman_mae, arima_rmse, arima_mae, order, winner (least RMSE, ties to arima) on the last rows."""

    def one(_: str, rows: pd.DataFrame) -> pd.DataFrame:
        y = rows["value"].to_numpy()
        columns = ["kalman_rmse", "kalman_mae", "arima_rmse", "arima_mae", "p", "d", "q", "winner"]
        best = arma.best_arima(y[:-holdout]) if len(y) > 4 * holdout else None
        if best is None:
            return pd.DataFrame([], columns=columns)
        train, test = y[:-holdout], y[-holdout:]
        k = state_space.fit(train).forecast(holdout)[:, 0] - test
        a = arma.forecast_arima(train, best[0], best[1], holdout) - test
        rmse = lambda e: float(np.sqrt((e**2).mean()))
        return pd.DataFrame([(rmse(k), float(np.abs(k).mean()), rmse(a), float(np.abs(a).mean()), *best[0], "kalman" if rmse(k) < rmse(a) else "arima")], columns=columns)

    return per_series(_known(series), one, "kalman_rmse double, kalman_mae double, arima_rmse double, arima_mae double, p int, d int, q int, winner string")


def hidden_regimes(returns: DataFrame, states: int = 4) -> DataFrame:
    """series_id, ts, value, state (by rising deviation), p (posteriors in that order), move (transition rows), loglik.

    Series of fewer than 10 values per state get one state with probability 1.
    """

    def one(_: str, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows["value"].to_numpy()
        k = states if len(x) >= 10 * states else 1
        model, loglik = hmm.fit_hmm(x, k)
        gamma, _, _ = model.forward_backward(x)
        out = rows[["ts", "value"]].copy()
        out["state"] = model.path(x)
        out["p"] = gamma.tolist()
        out["move"] = [model.move.ravel().tolist()] * len(x)
        out["loglik"] = loglik
        return out

    return per_series(spread(_known(returns), "series_id"), one, "ts date, value double, state int, p array<double>, move array<double>, loglik double")


def regimes_of_new(returns: DataFrame, new: DataFrame, states: int = 4) -> DataFrame:
    """series_id, ts, p: posteriors of new rows under the model fitted on the old ones; series without old rows give none."""

    def run(key: tuple, old: pd.DataFrame, fresh: pd.DataFrame) -> pd.DataFrame:
        old, fresh = old.sort_values("ts"), fresh.sort_values("ts")
        if not len(old) or not len(fresh):
            return pd.DataFrame([], columns=["series_id", "ts", "p"], dtype=object)
        model, _ = hmm.fit_hmm(old["value"].to_numpy(), states if len(old) >= 10 * states else 1)
        return pd.DataFrame({"series_id": key[0], "ts": fresh["ts"], "p": model.forward_backward(fresh["value"].to_numpy())[0].tolist()})

    named = lambda df, *names: _known(df).toDF(*names)  # noqa: E731 - both may come from one DataFrame
    pairs = named(returns, "series_id", "ts", "value").groupBy("series_id").cogroup(named(new, "new_id", "ts", "value").groupBy("new_id"))
    return pairs.applyInPandas(run, "series_id string, ts date, p array<double>")


def state_scores(returns: DataFrame, most: int = 5) -> DataFrame:
    """series_id, states, score: held-out log-likelihood per value of each number of states."""

    def one(_: str, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(sorted(hmm.choose_states(rows["value"].to_numpy(), most).items()), columns=["states", "score"])

    return per_series(spread(_known(returns), "series_id"), one, "states int, score double")


def current_regime(hidden: DataFrame, names: DataFrame, horizon: int = 14) -> DataFrame:
    """series_id, regime, confidence, transition_risk, days: of the last row of hidden_regimes, with names (state, name).

    Probabilities of states with one name are added; risk is that of having left the state after horizon steps.
    """

    @F.pandas_udf(DoubleType())
    def risk(move: pd.Series, state: pd.Series) -> pd.Series:
        out = []
        for m, s in zip(move, state, strict=True):
            k = int(round(len(m) ** 0.5))
            out.append(hmm.leaving_risk(np.array(m, float).reshape(k, k), int(s), horizon))
        return pd.Series(out)

    named = hidden.join(names, ["series_id", "state"], "left").withColumn("name", F.coalesce("name", F.lit("unknown")))
    last = named.groupBy("series_id").agg(F.max_by(F.struct("state", "p", "move", "name"), "ts").alias("l")).select("series_id", "l.*")
    mass = last.select("series_id", F.posexplode("p").alias("state", "mass")).join(names, ["series_id", "state"], "left").groupBy("series_id", "name").agg(F.sum("mass").alias("mass"))
    top = mass.groupBy("series_id").agg(F.max_by("name", F.struct("mass", "name")).alias("regime"), F.max("mass").alias("confidence"))
    from tidemark.operators.ordered import final_run

    days = final_run(named.select("series_id", "ts", F.col("name").alias("label"))).select("series_id", "days")
    return top.join(last.select("series_id", risk("move", "state").alias("transition_risk")), "series_id").join(days, "series_id")


def chained_imputation(matrix: DataFrame, group: str, row: str, name: str, value: str, names: list[str]) -> DataFrame:
    """group, row, name, value, filled: a numeric matrix in long form with its gaps filled, group by group."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot_table(index=row, columns=name, values=value, aggfunc="mean", dropna=False).reindex(columns=names)
        filled = chained.impute(wide.to_numpy(float))
        out = pd.DataFrame(filled, index=wide.index, columns=names).reset_index().melt(id_vars=row, var_name=name, value_name="value")
        was = wide.reset_index().melt(id_vars=row, var_name=name, value_name="old")
        return pd.DataFrame({group: key[0], row: out[row], name: out[name], "value": out["value"], "filled": was["old"].isna()})

    kind = matrix.schema[row].dataType.simpleString()
    return matrix.select(group, row, name, value).groupBy(group).applyInPandas(run, f"{group} string, {row} {kind}, {name} string, value double, filled boolean")


def granger(pairs: DataFrame, lags: int = 3, kind: str = "linear") -> DataFrame:
    """series_id, rmse_uni, rmse_bi, gain from y and x; kind: linear (ridge) or knn."""

    def one(_: str, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([regression.granger_gain(rows["y"].to_numpy(), rows["x"].to_numpy(), lags, kind)])

    return per_series(pairs.dropna(subset=["y", "x"]), one, "rmse_uni double, rmse_bi double, gain double")


def drivers(returns: DataFrame, targets: list[str], least_gain: float = 0.05, min_rows: int = 30) -> DataFrame:
    """source, target, gain: series whose lags improve the forecast of a stated target by more than least_gain.

    returns: series_id, ts, r. Sources meet a target through the day; pairs with fewer than min_rows common days are left out.
    """
    y = returns.where(F.col("series_id").isin(targets)).select(F.col("series_id").alias("target"), "ts", F.col("r").alias("y"))
    x = returns.select(F.col("series_id").alias("source"), "ts", F.col("r").alias("x"))
    pairs = x.join(y, "ts").where("source <> target").select(F.concat_ws("\u0001", "source", "target").alias("series_id"), "ts", "y", "x")
    enough = pairs.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows).select("series_id")
    gains = granger(pairs.join(enough, "series_id", "left_semi")).where(F.col("gain") > least_gain)
    return gains.select(F.split("series_id", "\u0001")[0].alias("source"), F.split("series_id", "\u0001")[1].alias("target"), "gain")


def full_causality(pairs: DataFrame, horizons: tuple[int, ...] = (1, 2, 3, 4), lags: int = 3, surrogates: int = 30) -> DataFrame:
    """series_id, horizon, score, p, significant, gain (neighbours), linear_gain of x on y that many rows ahead.

    All rows of a series count. Comparing all delay vectors is quadratic, so series are spread over more tasks than their
    bytes ask for. Surrogates are drawn with a seed made from the series' name.
    """
    import zlib

    def one(name: str, rows: pd.DataFrame) -> pd.DataFrame:
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        out = []
        for h in horizons:
            if len(y) - h < 20:
                continue
            ahead, source = y[h:], x[:-h]
            t = regression.cross_map_test(source, ahead, surrogates=surrogates, seed=zlib.crc32(f"{name}{h}".encode()))
            out.append((h, t["score"], t["p"], t["significant"], regression.granger_gain(ahead, source, lags, "knn")["gain"], regression.granger_gain(ahead, source, lags)["gain"]))
        return pd.DataFrame(out, columns=["horizon", "score", "p", "significant", "gain", "linear_gain"])

    return per_series(spread(pairs.dropna(subset=["y", "x"]), "series_id"), one, "horizon int, score double, p double, significant boolean, gain double, linear_gain double")


def fixed_local_level(series: DataFrame, h: float = 1.0, q: float = 0.1) -> DataFrame:
    """series_id, n, level, variance, loglik of a local level model with given variances: a fold inside the JVM."""
    rows = F.array_sort(F.collect_list(F.struct("ts", F.col("value").alias("y"))))
    init = F.struct(F.lit(None).cast("double").alias("a"), F.lit(0.0).alias("p"), F.lit(0.0).alias("l"))

    def step(s, r):
        p = s["p"] + q
        f = p + h
        v = r["y"] - s["a"]
        gain = p / f
        first = F.struct(r["y"].alias("a"), F.lit(h).alias("p"), F.lit(0.0).alias("l"))
        later = F.struct((s["a"] + gain * v).alias("a"), (p * (1 - gain)).alias("p"), (s["l"] - 0.5 * (F.log(F.lit(2 * np.pi) * f) + v * v / f)).alias("l"))
        return F.when(s["a"].isNull(), first).otherwise(later)

    folded = series.where("value is not null").groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.aggregate(rows, init, step).alias("s"))
    return folded.select("series_id", "n", F.col("s.a").alias("level"), F.col("s.p").alias("variance"), F.col("s.l").alias("loglik"))


def fixed_viterbi(returns: DataFrame, mean: tuple[float, float] = (0.0005, -0.001), sd: tuple[float, float] = (0.01, 0.03), stay: float = 0.95) -> DataFrame:
    """series_id, n, state, score: last state and log-probability of the best path of a given two-state model, as a fold."""
    rows = F.array_sort(F.collect_list(F.struct("ts", F.col("value").alias("x"))))
    log_b = lambda x, k: F.lit(-0.5 * np.log(2 * np.pi) - np.log(sd[k])) - 0.5 * F.pow((x - mean[k]) / sd[k], 2)
    keep, move = float(np.log(stay)), float(np.log(1 - stay))
    init = F.struct(F.lit(float(np.log(0.5))).alias("s0"), F.lit(float(np.log(0.5))).alias("s1"), F.lit(True).alias("first"))

    def step(s, r):
        to0 = F.when(s["first"], s["s0"]).otherwise(F.greatest(s["s0"] + keep, s["s1"] + move)) + log_b(r["x"], 0)
        to1 = F.when(s["first"], s["s1"]).otherwise(F.greatest(s["s1"] + keep, s["s0"] + move)) + log_b(r["x"], 1)
        return F.struct(to0.alias("s0"), to1.alias("s1"), F.lit(False).alias("first"))

    folded = returns.where("value is not null").groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.aggregate(rows, init, step).alias("s"))
    return folded.select("series_id", "n", F.when(F.col("s.s1") > F.col("s.s0"), 1).otherwise(0).alias("state"), F.greatest("s.s0", "s.s1").alias("score"))
