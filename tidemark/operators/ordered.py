"""Operators over ordered series: autocorrelation, tests built on it, embeddings, folds, runs, drawdown and entropy.

Input: series_id, ts, value (one row per series and time). The windows are partitioned by series; a series is bounded by its
calendar. What is quadratic in a series' length says so and spreads the series.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.series import by_series
from tidemark.functions.special import chi2_tail
from tidemark.kernels import regression
from tidemark.operators.estimators import per_series, spread


def positioned(series: DataFrame) -> DataFrame:
    """Adds pos (0-based) and n per series, without NULL values."""
    w = by_series()
    return series.where("value is not null").withColumn("pos", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("series_id")))


def autocorrelation(series: DataFrame, lags: int) -> DataFrame:
    """series_id, n, lag (0..lags), acf: biased, around the series' mean. Constant series and lags >= n give no rows.

    All lags come from one pass: each row meets its lagged values in one window, and the sums of products are aggregated.
    """
    w = by_series()
    centred = positioned(series).withColumn("c", F.col("value") - F.avg("value").over(W.partitionBy("series_id")))
    products = centred.select("series_id", "n", *[(F.col("c") * (F.lag("c", k).over(w) if k else F.col("c"))).alias(f"p{k}") for k in range(lags + 1)])
    sums = products.groupBy("series_id", "n").agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in range(lags + 1)])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"p{k}") / F.col("p0")).alias("acf")) for k in range(lags + 1)]))
    return sums.where("p0 > 0").select("series_id", "n", pairs.alias("x")).select("series_id", "n", "x.lag", "x.acf").where("lag < n and acf is not null")


def ljung_box(acf: DataFrame, lags: Column | int) -> DataFrame:
    """series_id, n, m, q, p from autocorrelations; lags: how many to use, a number or an expression of n."""
    m = F.lit(lags) if isinstance(lags, int) else lags
    used = acf.where(F.col("lag") >= 1).withColumn("m", m.cast("int")).where(F.col("lag") <= F.col("m"))
    q = used.groupBy("series_id", "n", "m").agg((F.first(F.col("n") * (F.col("n") + 2)) * F.sum(F.pow("acf", 2) / (F.col("n") - F.col("lag")))).alias("q"))
    return q.withColumn("p", chi2_tail(F.col("q"), F.col("m").cast("double")))


def seasonality(acf: DataFrame) -> DataFrame:
    """series_id, lag: the first lag in 6..min(40, n/3) whose autocorrelation exceeds 2/sqrt(n); NULL if none."""
    hit = (F.col("lag") >= 6) & (F.col("lag") <= F.least(F.lit(40), F.floor(F.col("n") / 3))) & (F.abs("acf") > 2 / F.sqrt(F.col("n").cast("double")))
    return acf.groupBy("series_id").agg(F.min(F.when(hit, F.col("lag"))).alias("lag"))


def autocorrelation_strength(acf: DataFrame) -> DataFrame:
    """series_id, strength: mean absolute autocorrelation of lags 1..min(5, n/3)."""
    use = (F.col("lag") >= 1) & (F.col("lag") <= F.least(F.lit(5), F.floor(F.col("n") / 3)))
    return acf.groupBy("series_id").agg(F.avg(F.when(use, F.abs("acf"))).alias("strength"))


def noise_to_signal(series: DataFrame) -> DataFrame:
    """series_id, nsr: population variance of the first difference over that of the series."""
    d = series.where("value is not null").withColumn("d", F.col("value") - F.lag("value").over(by_series()))
    return d.groupBy("series_id").agg(F.try_divide(F.var_pop("d"), F.var_pop("value")).alias("nsr"))


def should_filter(series: DataFrame, period: int, nsr_threshold: float = 0.1, alpha: float = 0.05) -> DataFrame:
    """series_id, nsr, p, filter: whether noise dominates and the differences are autocorrelated."""
    d = series.where("value is not null").withColumn("value", F.col("value") - F.lag("value").over(by_series())).where("value is not null")
    lb = ljung_box(autocorrelation(d, period), period).select("series_id", "p")
    return noise_to_signal(series).join(lb, "series_id", "left").withColumn("filter", F.coalesce((F.col("nsr") > nsr_threshold) & (F.col("p") < alpha), F.lit(False)))


def filter_metrics(parts: DataFrame) -> DataFrame:
    """series_id, snr_db, dominance, variance_original, variance_filtered, variance_residual (population variances)."""
    v = parts.groupBy("series_id").agg(*[F.var_pop(c).alias(f"variance_{c}") for c in ("original", "filtered", "residual")])
    snr = F.expr("10 * log10(try_divide(variance_filtered, variance_residual))")
    return v.select("series_id", snr.alias("snr_db"), F.expr("(1 - try_divide(variance_residual, variance_original)) * 100").alias("dominance"), *[c for c in v.columns if c != "series_id"])


def filter_entropies(parts: DataFrame) -> DataFrame:
    """series_id, entropy_original, entropy_filtered: sample entropies before and after a filter (needs ts)."""
    each = [sample_entropy(parts.select("series_id", "ts", F.col(c).alias("value"))).withColumnRenamed("entropy", f"entropy_{c}") for c in ("original", "filtered")]
    return each[0].join(each[1], "series_id")


def drawdown(series: DataFrame) -> DataFrame:
    """series_id, ts, drawdown: distance of the compounded return from its running maximum; returns of -1 or less count as -0.999999."""
    w = by_series()
    r = series.where("value is not null").withColumn("r", F.greatest(F.coalesce(F.try_divide(F.col("value"), F.lag("value").over(w)) - 1, F.lit(0.0)), F.lit(-0.999999)))
    grown = r.withColumn("grown", F.exp(F.sum(F.log1p("r")).over(w)))
    top = F.max("grown").over(w)
    return grown.select("series_id", "ts", ((F.col("grown") - top) / top).alias("drawdown"))


def final_run(labels: DataFrame) -> DataFrame:
    """series_id, label, days: length of the run of equal labels at the series' end."""
    last = labels.groupBy("series_id").agg(F.max_by("label", "ts").alias("label"))
    other = labels.join(last.withColumnRenamed("label", "final"), "series_id").groupBy("series_id").agg(F.first("final").alias("label"), F.max(F.when(F.col("label") != F.col("final"), F.col("ts"))).alias("broke"))
    return labels.join(other.select("series_id", F.col("label").alias("final"), "broke"), "series_id").groupBy("series_id", F.col("final").alias("label")).agg(
        F.count_if(F.col("broke").isNull() | (F.col("ts") > F.col("broke"))).alias("days")
    )


def transitions(labels: DataFrame) -> DataFrame:
    """Adds changed: the label differs from the one before; false on the first row."""
    return labels.withColumn("changed", F.coalesce(F.col("label") != F.lag("label").over(by_series()), F.lit(False)))


def lag_matrix(pairs: DataFrame, lags: int) -> DataFrame:
    """series_id, ts, y, y1.., x1..: target lags first, then source lags; rows without all lags are left out."""
    w = by_series()
    cols = [F.lag(c, k).over(w).alias(f"{c}{k}") for c in ("y", "x") for k in range(1, lags + 1)]
    made = pairs.select("series_id", "ts", "y", *cols)
    return made.dropna(subset=[c for c in made.columns if c not in ("series_id", "ts")])


def delay_embedding(series: DataFrame, dim: int = 3, tau: int = 1) -> DataFrame:
    """series_id, ts, pos, vector: dim values tau apart ending at the row, oldest first."""
    w = by_series()
    parts = [F.lag("value", (dim - 1 - k) * tau).over(w) for k in range(dim)]
    return positioned(series).select("series_id", "ts", "pos", "value", F.array(*parts).alias("vector")).where(F.col("pos") >= (dim - 1) * tau)


def expanding_folds(rows: DataFrame, folds: int = 5) -> DataFrame:
    """Adds fold (1..folds, NULL for rows that are only ever trained on): test blocks of n/(folds+1) rows at the end.

    Needs pos and n. Fold f trains on all rows before its block.
    """
    size = F.floor(F.col("n") / (folds + 1))
    first = F.col("n") - size * folds
    return rows.withColumn("fold", F.when((size > 0) & (F.col("pos") >= first), F.floor((F.col("pos") - first) / size) + 1).cast("int"))


def sample_entropy(series: DataFrame, last: int | None = None, m: int = 2, ratio: float = 0.2) -> DataFrame:
    """series_id, entropy: -ln(A/B) of template matches within ratio population deviations; NULL without matches.

    All rows of a series count; being quadratic in its length, series are spread over more tasks than their bytes ask for.
    last: use only each series' last rows.
    """
    known = series.where("value is not null")
    if last is not None:
        known = positioned(series).where(F.col("pos") >= F.col("n") - last)

    def one(_: str, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(regression.sample_entropy(rows["value"].to_numpy(float), m, ratio),)], columns=["entropy"])

    found = per_series(spread(known.select("series_id", "ts", "value"), "series_id"), one, "entropy double")
    return series.select("series_id").distinct().join(found, "series_id", "left").select("series_id", F.nanvl("entropy", F.lit(None).cast("double")).alias("entropy"))


def hurst_slope(series: DataFrame, most: int = 20) -> DataFrame:
    """series_id, slope: of ln(sqrt(std of lagged differences)) on ln(lag), lags 2..min(most, n/2)-1; 0.5 below two lags."""
    w = by_series()
    p = positioned(series)
    diffs = p.select("series_id", "n", *[(F.col("value") - F.lag("value", k).over(w)).alias(f"d{k}") for k in range(2, most)])
    sds = diffs.groupBy("series_id", "n").agg(*[F.stddev_pop(f"d{k}").alias(f"s{k}") for k in range(2, most)])
    rows = sds.select("series_id", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"s{k}").alias("s")) for k in range(2, most)])).alias("x")).select("series_id", "n", "x.*")
    used = rows.where((F.col("lag") < F.least(F.lit(most), F.floor(F.col("n") / 2))) & (F.col("s") > 0))
    return p.select("series_id").distinct().join(
        used.groupBy("series_id").agg(F.when(F.count(F.lit(1)) >= 2, F.regr_slope(F.log(F.sqrt("s")), F.log(F.col("lag").cast("double")))).alias("slope")), "series_id", "left"
    ).select("series_id", F.coalesce("slope", F.lit(0.5)).alias("slope"))


def histogram_entropy(series: DataFrame, bins: int = 20) -> DataFrame:
    """series_id, entropy: -sum h ln h over equal bins between minimum and maximum, h being densities; the last bin is closed.

    A constant series is widened by 0.5 to both sides.
    """
    s = series.where("value is not null").groupBy("series_id").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.count(F.lit(1)).alias("n"))
    s = s.select("series_id", "n", F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    binned = series.where("value is not null").join(s, "series_id").withColumn("width", (F.col("b") - F.col("a")) / bins).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("a")) / F.col("width"))))
    h = binned.groupBy("series_id", "bin").agg((F.count(F.lit(1)) / (F.first("n") * F.first("width"))).alias("h"))
    return h.groupBy("series_id").agg((-F.sum(F.col("h") * F.log("h"))).alias("entropy"))


def trend_and_noise(series: DataFrame) -> DataFrame:
    """series_id, slope and r2 of the regression on the row number, and outliers: share of values beyond 3 population deviations."""
    w = W.partitionBy("series_id")
    p = positioned(series).withColumn("z", F.abs(F.col("value") - F.avg("value").over(w)) / (F.stddev_pop("value").over(w) + 1e-12))
    return p.groupBy("series_id").agg(F.regr_slope("value", "pos").alias("slope"), F.regr_r2("value", "pos").alias("r2"), F.avg(F.when(F.col("z") > 3, 1.0).otherwise(0.0)).alias("outliers"))


def chronological_split(series: DataFrame, share: float = 0.8) -> DataFrame:
    """Adds part: 'train' for the first floor(share * n) rows, 'test' for the rest; needs pos and n."""
    return series.withColumn("part", F.when(F.col("pos") < F.floor(F.col("n") * share), "train").otherwise("test"))
