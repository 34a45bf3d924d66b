"""Walk-forward backtests: forecast origins against history and later values, by equi-joins on a daily spine.

A range join of origins with all rows up to and after them would read each row once per origin. Here the value held on every
calendar day, with the number of observations up to it, is computed in one window; an origin and its target day are then two
equi-joins on (series, day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.series import by_series


def held_values(series: DataFrame) -> DataFrame:
    """series_id, day, held, observed (its day), seen (observations so far), sigma (deviation of the last 30 returns)."""
    w = by_series()
    r = F.try_divide(F.col("value"), F.lag("value").over(w)) - 1
    rows = series.where("value is not null").withColumn("r", r).withColumn("seen", F.row_number().over(w)).withColumn("sigma", F.stddev_samp("r").over(w.rowsBetween(-29, 0)))
    span = rows.groupBy("series_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    spine = span.select("series_id", F.explode(F.sequence("a", "b")).alias("day"))
    facts = rows.select("series_id", F.col("ts").alias("day"), F.struct(F.col("value").alias("held"), F.col("ts").alias("observed"), "seen", "sigma").alias("f"))
    last = F.last("f", ignorenulls=True).over(W.partitionBy("series_id").orderBy("day").rowsBetween(W.unboundedPreceding, 0))
    return spine.join(facts, ["series_id", "day"], "left").select("series_id", "day", last.alias("f")).select("series_id", "day", "f.*")


def origins_and_actuals(series: DataFrame, start: str, end: str, horizon: int = 7, step: int = 7, min_history: int = 120) -> DataFrame:
    """series_id, origin, history, price, sigma, actual: per origin the as-of price and the last value within the horizon.

    Origins run from start to end inclusive in steps of step days; those with fewer than min_history observations or none in
    (origin, origin + horizon] are left out.
    """
    held = held_values(series)
    span = held.groupBy("series_id").agg(F.max("day").alias("b"))
    dates = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {step} days")))
    wanted = span.select("series_id", "b", dates.alias("origin")).withColumn("until", F.least(F.date_add("origin", horizon), F.col("b"))).withColumn("asof", F.least("origin", "b"))
    at = held.select("series_id", F.col("day").alias("asof"), F.col("held").alias("price"), F.col("seen").alias("history"), "sigma")
    later = held.select("series_id", F.col("day").alias("until"), F.col("held").alias("actual"), "observed")
    return (
        wanted.join(at, ["series_id", "asof"]).join(later, ["series_id", "until"])
        .where((F.col("history") >= min_history) & (F.col("observed") > F.col("origin")))
        .select("series_id", "origin", F.col("history").cast("long").alias("history"), "price", "sigma", "actual")
    )


def naive_forecasts(origins: DataFrame, horizon: int = 7, z: float = 1.96) -> DataFrame:
    """Adds forecast (persistence) and lower, upper: price plus or minus z * price * sigma * sqrt(horizon)."""
    width = z * F.col("price") * F.coalesce("sigma", F.lit(0.0)) * F.sqrt(F.lit(float(horizon)))
    return origins.withColumn("forecast", F.col("price")).withColumn("lower", F.col("price") - width).withColumn("upper", F.col("price") + width)


def error_metrics(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, mae, rmse, mape, direction (%), coverage (%) of forecast, lower, upper against actual; a tie is a fall."""
    e = F.col("forecast") - F.col("actual")
    up = lambda c: F.col(c) > F.col("price")
    percent = F.when(F.col("actual") == 0, 0.0).otherwise(F.abs(e) / F.abs("actual") * 100)
    share = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    return records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(percent).alias("mape"), share(up("actual") == up("forecast")).alias("direction"),
        share((F.col("lower") <= F.col("actual")) & (F.col("actual") <= F.col("upper"))).alias("coverage"),
    )


def with_regime(origins: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds regime: the last label on or before the origin, 'unknown' before the first; an as-of join by union and one window."""
    w = W.partitionBy("series_id").orderBy("day", "kind").rowsBetween(W.unboundedPreceding, 0)
    l = labels.select("series_id", F.col("ts").alias("day"), F.lit(0).alias("kind"), "label")
    o = origins.select("series_id", F.col("origin").alias("day"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("label"), F.struct(*origins.columns).alias("row"))
    both = l.unionByName(o, allowMissingColumns=True).withColumn("regime", F.last("label", ignorenulls=True).over(w))
    return both.where("kind = 1").select("row.*", F.coalesce("regime", F.lit("unknown")).alias("regime"))


def crisis_counters(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, actual, detected, false_alerts, missed: falls over 10 %, crises with a fall over 5 %, crises without one of 2 %."""
    r = F.try_divide(F.col("actual"), F.col("price")) - 1
    crisis = F.col("regime") == "crisis"
    out = records.groupBy(*keys).agg(F.count_if(r < -0.10).alias("actual_crises"), F.count_if(crisis & (r < -0.05)).alias("detected"), F.count_if(crisis & (r > -0.02)).alias("false_alerts"))
    return out.withColumn("missed", F.greatest(F.lit(0), F.col("actual_crises") - F.col("detected")).cast("long"))


def distribution(records: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """keys, column, share (%) of the rows of the key."""
    counts = records.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*keys, column, (100 * F.col("n") / F.sum("n").over(W.partitionBy(*keys))).alias("share"))


def pipeline_choice(regime: Column, stationary: Column, strength: Column) -> Column:
    """Which pipeline suits: crisis first, then non-stationary data, then strong autocorrelation."""
    return F.when(regime == "crisis", "crisis").when(~stationary, "aggressive").when(strength > 0.3, "trend_following").otherwise("conservative")


def regime_validation(series: DataFrame, labels: DataFrame) -> DataFrame:
    """series_id, crisis and other mean volatility, crisis mean drawdown, and whether both point the way a crisis should.

    Without crisis days (or other days) volatility agrees by default, with up to five crisis days drawdown does.
    """
    from tidemark.functions.series import annualised_volatility
    from tidemark.operators.ordered import drawdown

    w = by_series()
    r = series.where("value is not null").withColumn("r", F.try_divide(F.col("value"), F.lag("value").over(w)) - 1)
    v = r.select("series_id", "ts", annualised_volatility("r", w).alias("volatility")).join(drawdown(series), ["series_id", "ts"]).join(labels, ["series_id", "ts"])
    crisis = F.col("label") == "crisis"
    out = v.groupBy("series_id").agg(
        F.avg(F.when(crisis, F.col("volatility"))).alias("crisis_vol"), F.avg(F.when(~crisis, F.col("volatility"))).alias("other_vol"), F.avg(F.when(crisis, F.col("drawdown"))).alias("crisis_drawdown"), F.count_if(crisis).alias("crisis_days"),
    )
    return out.withColumn("vol_aligned", F.coalesce(F.col("crisis_vol") > F.col("other_vol"), F.lit(True))).withColumn("drawdown_aligned", F.when(F.col("crisis_days") > 5, F.col("crisis_drawdown") < -0.05).otherwise(True))
