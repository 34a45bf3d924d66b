"""Forecast diagnostics: the seven residual tests, their report, and the short check of a fitted pipeline.

Input of the report: series_id, ts, actual and one column per model. Models are turned into rows once; every test then is an
aggregate or a kernel over (series_id, model), however many models there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import by_series
from tidemark.kernels import residuals as rs
from tidemark.operators.ordered import histogram_entropy, hurst_slope

# Limits of the tests.
LEAST_RESIDUALS, NORMAL_P, NOISE_P, SPECTRUM, HURST, ENTROPY = 5, 0.05, 0.05, 1.2, (0.4, 0.6), 0.75


def at_horizon(frame: DataFrame, horizon: int | None, column: str = "horizon_step") -> DataFrame:
    """The forecasts of one horizon, before anything is lagged or tested; all of them where none is asked for."""
    return frame if horizon is None else frame.where(F.col(column) == horizon)


def residual_rows(frame: DataFrame, models: list[str]) -> DataFrame:
    """series_id, ts, model, actual, predicted, residual (actual - predicted), naive, snaive (lags 1 and 4 of actual)."""
    w = by_series()
    lagged = frame.select("series_id", "ts", "actual", *models).withColumn("naive", F.lag("actual", 1).over(w)).withColumn("snaive", F.lag("actual", 4).over(w))
    long = lagged.unpivot(["series_id", "ts", "actual", "naive", "snaive"], models, "model", "predicted")
    return long.withColumn("residual", F.col("actual") - F.col("predicted"))


def baseline_check(rows: DataFrame) -> DataFrame:
    """series_id, model, n, mae, rmse, mae_naive, mae_snaive, baseline: the model beats both naive forecasts.

    The naive errors run over all rows, the model's over those it predicted.
    """
    e = F.abs("residual")
    m = rows.groupBy("series_id", "model").agg(
        F.count("residual").alias("n"), F.avg(e).alias("mae"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"),
        F.avg(F.abs(F.col("actual") - F.col("naive"))).alias("mae_naive"), F.avg(F.abs(F.col("actual") - F.col("snaive"))).alias("mae_snaive"),
    )
    return m.withColumn("baseline", F.coalesce((F.col("mae") < F.col("mae_naive")) & (F.col("mae") < F.col("mae_snaive")), F.lit(False)))


def kernel_tests(rows: DataFrame) -> DataFrame:
    """series_id, model, noise_p, normal_p, spectrum of the residuals."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("ts")["residual"].to_numpy(float)
        x = x[np.isfinite(x)]
        short = len(x) < LEAST_RESIDUALS
        noise = np.nan if short else rs.ljung_box(x, max(1, min(10, len(x) // 5)))[1]
        return pd.DataFrame([(*key, noise, np.nan if short else rs.shapiro(x)[1], np.nan if short else rs.spectrum_variation(x))], columns=["series_id", "model", "noise_p", "normal_p", "spectrum"])

    return rows.select("series_id", "model", "ts", "residual").groupBy("series_id", "model").applyInPandas(run, "series_id string, model string, noise_p double, normal_p double, spectrum double")


def forensic_report(frame: DataFrame, models: list[str]) -> DataFrame:
    """One row per series and model with every test's figure, whether it passed, and the share passed, best first.

    Models with fewer than five residuals are left out. Ties of the score go to the smaller MAE, then the name.
    """
    rows = residual_rows(frame, models)
    keyed = rows.where("residual is not null").select(F.concat_ws("\u0001", "series_id", "model").alias("series_id"), "ts", F.col("residual").alias("value"))
    back = lambda df: df.select(F.split("series_id", "\u0001")[0].alias("series_id"), F.split("series_id", "\u0001")[1].alias("model"), *[c for c in df.columns if c != "series_id"])
    spread = rows.where("residual is not null").groupBy("series_id", "model").agg(F.count_distinct("residual").alias("distinct_residuals"))
    r = baseline_check(rows).where(F.col("n") >= LEAST_RESIDUALS).join(kernel_tests(rows), ["series_id", "model"]).join(back(hurst_slope(keyed)), ["series_id", "model"]).join(back(histogram_entropy(keyed)), ["series_id", "model"]).join(spread, ["series_id", "model"])
    own = histogram_entropy(frame.select("series_id", "ts", F.col("actual").alias("value"))).withColumnRenamed("entropy", "own_entropy")
    r = r.join(own, "series_id", "left")
    ratio = F.when(F.coalesce("own_entropy", F.lit(0.0)) == 0, 1.0).otherwise(F.col("entropy") / F.col("own_entropy"))
    r = (
        r.withColumn("noise", F.coalesce(F.col("noise_p") > NOISE_P, F.lit(False))).withColumn("normal", F.coalesce(F.col("normal_p") > NORMAL_P, F.lit(False)))
        .withColumn("flat", F.coalesce(F.col("spectrum") < SPECTRUM, F.lit(False))).withColumn("memoryless", F.col("slope").between(*HURST)).withColumn("entropy_ratio", ratio).withColumn("random", F.col("entropy_ratio") > ENTROPY)
    )
    tests = ["baseline", "noise", "normal", "flat", "memoryless", "random"]
    passed = sum((F.col(t).cast("int") for t in tests), F.lit(0))
    return r.withColumn("score", passed / len(tests)).orderBy("series_id", F.desc("score"), "mae", "model")


def pipeline_check(residuals: DataFrame) -> DataFrame:
    """series_id, n, centred, noise, normal, finite, passed: four checks of a fitted pipeline (series_id, ts, value).

    centred: mean within 2 standard errors; noise: p over 0.05; normal: p over 0.01. Under ten residuals nothing passes.
    """

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("ts")["value"].to_numpy(float)
        x = x[np.isfinite(x)]
        columns = ["series_id", "n", "centred", "noise", "normal", "finite"]
        if len(x) < 10:
            return pd.DataFrame([(key[0], len(x), False, False, False, False)], columns=columns)
        sd = x.std()
        row = (key[0], len(x), bool(abs(x.mean()) < 2 * sd / np.sqrt(len(x))), bool(rs.ljung_box(x, min(10, len(x) // 5))[1] > 0.05), bool(rs.shapiro(x)[1] > 0.01), bool(np.isfinite(sd)))
        return pd.DataFrame([row], columns=columns)

    out = residuals.select("series_id", "ts", "value").groupBy("series_id").applyInPandas(run, "series_id string, n long, centred boolean, noise boolean, normal boolean, finite boolean")
    return out.withColumn("passed", sum((F.col(c).cast("int") for c in ("centred", "noise", "normal", "finite")), F.lit(0)))


def feature_leakage(rows: DataFrame, target: str, features: list[str], folds: int = 3, seed: int = 42) -> DataFrame:
    """r2, adjusted, clean: how well a random forest finds the residual in the features, out of fold; clean up to 0.05.

    Rows lacking the target or a feature are left out, of both. Without rows r2 is NULL and clean is true.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    full = rows.dropna(subset=[target, *features]).select(F.col(target).cast("double").alias("y"), *features)
    full = full.withColumn("fold", F.pmod(F.xxhash64("y", *features), F.lit(folds)))
    ready = VectorAssembler(inputCols=features, outputCol="x").transform(full).select("x", "y", "fold").cache()
    n = ready.count()
    scored = None
    if n > 10 * folds:
        forest = RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=50, maxDepth=3, seed=seed)
        for f in range(folds):
            part = forest.fit(ready.where(F.col("fold") != f)).transform(ready.where(F.col("fold") == f)).select("y", "prediction")
            scored = part if scored is None else scored.unionByName(part)
    else:
        scored = ready.select("y", F.col("y").alias("prediction")).limit(0)
    r2 = 1 - F.try_divide(F.sum(F.pow(F.col("y") - F.col("prediction"), 2)), F.var_pop("y") * F.count("y"))
    out = scored.agg(r2.alias("r2"), F.count("y").alias("n"))
    adjusted = 1 - F.try_divide((1 - F.col("r2")) * (F.col("n") - 1), F.greatest(F.lit(1), F.col("n") - len(features) - 1))
    return out.withColumn("adjusted", adjusted).withColumn("clean", F.coalesce(F.col("adjusted") <= 0.05, F.lit(True)))
