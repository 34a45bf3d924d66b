"""Causality between paired series: convergent cross mapping and Granger gain, as joins and aggregates.

Input of both: series_id, ts, y (target), x (source). Series are independent.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.series import by_series
from tidemark.kernels import regression
from tidemark.operators.estimators import per_series, spread

# What a source can be to a target; by a significant cross map (or none) and a useful gain (or none).
CLASSES = {(True, True): "Strong Causal Driver", (True, False): "Structural Cause (Hidden)", (False, True): "Predictive Proxy", (False, False): "Noise/Irrelevant"}
USEFUL_GAIN = 0.01


def cross_map_score(pairs: DataFrame, dim: int = 3, tau: int = 1, last: int | None = None) -> DataFrame:
    """series_id, points, score: how well the target's delay vectors find the source again.

    For every point the dim + 1 nearest other delay vectors of y (ties by position) predict x by their plain mean; the score
    is the correlation of prediction and x, 0 if negative, undefined, or with fewer than dim * tau + 5 rows. All rows of a
    series count, compared in blocks of rows; series are spread over more tasks than their bytes ask for. last: use only each
    series' last rows. Series too short for one vector give no row.
    """
    known = pairs.where("y is not null and x is not null").select("series_id", "ts", "y", "x")
    if last is not None:
        known = known.withColumn("back", F.row_number().over(W.partitionBy("series_id").orderBy(F.desc("ts")))).where(F.col("back") <= last)

    def one(_: str, rows: pd.DataFrame) -> pd.DataFrame:
        points = len(rows) - (dim - 1) * tau
        found = [(points, regression.cross_map(rows["x"].to_numpy(float), rows["y"].to_numpy(float), dim, tau))] if points > 1 else []
        return pd.DataFrame(found, columns=["points", "score"])

    return per_series(spread(known, "series_id"), one, "points long, score double")


def granger_gain_one_lag(pairs: DataFrame, alpha: float = 1.0, folds: int = 5) -> DataFrame:
    """series_id, rmse_uni, rmse_bi, gain: ridge regression of y on its lag, without and with the lag of x.

    Expanding folds; a fold's model needs only sums over the rows before it, so each row is aggregated once into its fold's
    block and the blocks are added up. gain = max(0, 1 - bi/uni), 0 if uni is 0.
    """
    w = by_series()
    rows = pairs.select("series_id", "ts", "y", F.lag("y").over(w).alias("a"), F.lag("x").over(w).alias("b")).where("y is not null and a is not null and b is not null")
    rows = rows.withColumn("pos", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("series_id")))
    size = F.floor(F.col("n") / (folds + 1))
    rows = rows.withColumn("fold", F.when(F.col("pos") < F.col("n") - size * folds, 0).otherwise(F.floor((F.col("pos") - (F.col("n") - size * folds)) / size) + 1).cast("int"))
    products = {"y": "y", "a": "a", "b": "b", "ya": "y*a", "yb": "y*b", "aa": "a*a", "ab": "a*b", "bb": "b*b"}
    blocks = rows.groupBy("series_id", "fold").agg(F.count(F.lit(1)).cast("double").alias("m"), *[F.sum(F.expr(e)).alias(f"s_{k}") for k, e in products.items()])
    before = W.partitionBy("series_id").orderBy("fold").rowsBetween(W.unboundedPreceding, -1)
    past = blocks.select("series_id", "fold", *[F.sum(c).over(before).alias(c) for c in ["m", *[f"s_{k}" for k in products]]]).where("fold > 0")
    centred = lambda u, v, k: F.col(f"s_{k}") - F.col(f"s_{u}") * F.col(f"s_{v}") / F.col("m")
    model = past.select(
        "series_id", "fold", (F.col("s_y") / F.col("m")).alias("my"), (F.col("s_a") / F.col("m")).alias("ma"), (F.col("s_b") / F.col("m")).alias("mb"),
        centred("y", "a", "ya").alias("ya"), centred("y", "b", "yb").alias("yb"), (centred("a", "a", "aa") + alpha).alias("aa"), centred("a", "b", "ab").alias("ab"), (centred("b", "b", "bb") + alpha).alias("bb"),
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    model = model.select(
        "series_id", "fold", "my", "ma", "mb", (F.col("ya") / F.col("aa")).alias("u"),
        ((F.col("ya") * F.col("bb") - F.col("yb") * F.col("ab")) / det).alias("wa"), ((F.col("yb") * F.col("aa") - F.col("ya") * F.col("ab")) / det).alias("wb"),
    )
    tested = rows.where("fold > 0").join(model, ["series_id", "fold"])
    uni = F.col("y") - F.col("my") - F.col("u") * (F.col("a") - F.col("ma"))
    bi = F.col("y") - F.col("my") - F.col("wa") * (F.col("a") - F.col("ma")) - F.col("wb") * (F.col("b") - F.col("mb"))
    per_fold = tested.groupBy("series_id", "fold").agg(F.avg(uni * uni).alias("uni"), F.avg(bi * bi).alias("bi"))
    out = per_fold.groupBy("series_id").agg(F.sqrt(F.avg("uni")).alias("rmse_uni"), F.sqrt(F.avg("bi")).alias("rmse_bi"))
    return out.withColumn("gain", F.when(F.col("rmse_uni") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("rmse_bi") / F.col("rmse_uni"))))


def causal_class(tested: DataFrame) -> DataFrame:
    """series_id, class from rows per horizon with significant (bool), gain and score: any significant, mean gain over 1 %."""
    s = tested.groupBy("series_id").agg(F.bool_or("significant").alias("any"), F.avg("gain").alias("gain"), F.avg("score").alias("score"))
    name = F.create_map(*[F.lit(x) for (any_hit, useful), label in CLASSES.items() for x in (f"{any_hit}{useful}".lower(), label)])[F.concat(F.col("any").cast("string"), (F.col("gain") > USEFUL_GAIN).cast("string"))]
    return s.select("series_id", name.alias("class"), F.bround("score", 3).alias("score"), F.bround(F.col("gain") * 100, 1).alias("gain_percent"))
