"""Time alignment: frequency inference, resampling, mixed-frequency assembly, spines and coverage.

All operators take and give the long form (series_id, ts, value), one row per series and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.series import month_of_quarter, quarter_end, week_end

# Mean gap in days up to which a series has a seasonal period, and a frequency class.
PERIODS = ((1.5, 7), (8, 52), (32, 12), (93, 4))
CLASSES = ((8, "D"), (32, "M"))
AGGREGATIONS = ("last", "mean", "sum", "first", "min", "max")


def mean_gap(series: DataFrame) -> DataFrame:
    """series_id, n, gap: mean distance in days. The gaps telescope, so one aggregate is enough."""
    ends = series.where("value is not null").groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return ends.select("series_id", "n", F.expr("try_divide(datediff(b, a), n - 1)").alias("gap"))


def seasonal_period(series: DataFrame) -> DataFrame:
    """series_id, gap, period: 7 up to 1.5 days, 52 up to 8, 12 up to 32, 4 up to 93, else 1; 1 for fewer than two points."""
    period = F.when(F.col("n") < 2, 1)
    for gap, rows in PERIODS:
        period = period.when(F.col("gap") <= gap, rows)
    return mean_gap(series).select("series_id", "gap", period.otherwise(1).alias("period"))


def frequency_class(series: DataFrame) -> DataFrame:
    """series_id, freq: D up to a mean gap of 8 days, M up to 32, else Q."""
    label = F
    for gap, name in CLASSES:
        label = label.when(F.col("gap") <= gap, name)
    return mean_gap(series).select("series_id", label.otherwise("Q").alias("freq"))


def _aggregate(how: str) -> Column:
    if how not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {how!r}; one of {', '.join(AGGREGATIONS)}")
    known = F.when(F.col("value").isNotNull(), F.col("ts"))
    return {
        "last": F.max_by("value", known), "first": F.min_by("value", known), "mean": F.avg("value"), "min": F.min("value"), "max": F.max("value"), "sum": F.coalesce(F.sum("value"), F.lit(0.0)),
    }[how]


def resample_quarters(series: DataFrame, how: str = "last", targets: DataFrame | None = None) -> DataFrame:
    """series_id, quarter, value: one row per quarter of the series' own span, or per target date (column quarter).

    Quarters inside the span without rows are NULL (0 for sum), target dates outside it are NULL.
    """
    quarters = series.withColumn("quarter", quarter_end(F.col("ts"))).groupBy("series_id", "quarter").agg(_aggregate(how).alias("value"))
    span = quarters.groupBy("series_id").agg(F.min("quarter").alias("a"), F.max("quarter").alias("b"))
    spine = span.select("series_id", F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 3 months"))).alias("m")).select("series_id", F.last_day("m").alias("quarter"))
    inside = spine.join(quarters, ["series_id", "quarter"], "left")
    if how == "sum":
        inside = inside.fillna(0.0, ["value"])
    if targets is None:
        return inside
    dates = targets.agg(F.collect_set("quarter").alias("dates"))  # one row; target dates are as many as there are quarters
    wanted = span.select("series_id").crossJoin(F.broadcast(dates)).select("series_id", F.explode("dates").alias("quarter"))
    return wanted.join(inside, ["series_id", "quarter"], "left")


def quarter_statistics(series: DataFrame) -> DataFrame:
    """series_id, quarter, mean, std (sample), min, max, last."""
    return series.withColumn("quarter", quarter_end(F.col("ts"))).groupBy("series_id", "quarter").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), _aggregate("last").alias("last")
    )


def months_of_quarter(series: DataFrame) -> DataFrame:
    """series_id, quarter, m1, m2, m3: mean of each month of the quarter."""
    months = series.withColumn("quarter", quarter_end(F.col("ts"))).withColumn("m", month_of_quarter(F.col("ts")))
    return months.groupBy("series_id", "quarter").agg(*[F.avg(F.when(F.col("m") == k, F.col("value"))).alias(f"m{k}") for k in (1, 2, 3)])


def mixed_frequency_features(series: DataFrame, key: str = "series_id") -> DataFrame:
    """key, quarter, feature, value in long form: five statistics of daily and weekly series, three months of monthly ones, the quarterly as they are.

    The series' frequency is inferred by frequency_class; a label such as QE-DEC never makes a quarterly series daily.
    """
    plain = ["series_id", "ts", "value"]
    typed = series.select(*plain).join(frequency_class(series).withColumnRenamed("freq", "class"), "series_id")
    daily = quarter_statistics(typed.where("class = 'D'").select(*plain)).unpivot(["series_id", "quarter"], ["mean", "std", "min", "max", "last"], "feature", "value")
    monthly = months_of_quarter(typed.where("class = 'M'").select(*plain)).unpivot(["series_id", "quarter"], ["m1", "m2", "m3"], "feature", "value")
    quarterly = typed.where("class = 'Q'").groupBy("series_id", quarter_end(F.col("ts")).alias("quarter")).agg(_aggregate("last").alias("value")).select("series_id", "quarter", F.lit("value").alias("feature"), "value")
    return daily.unionByName(monthly).unionByName(quarterly).withColumnRenamed("series_id", key)


def wide(features: DataFrame, index: str, name: str, value: str, names: list[str]) -> DataFrame:
    """One row per index, one column per listed name: a single shuffle, where a chain of outer joins needs one each."""
    return features.groupBy(index).pivot(name, names).agg(F.first(value, ignorenulls=True))


def aligned(series: DataFrame, freq: str = "D", method: str = "ffill") -> DataFrame:
    """series_id, ts, value on every period of each series' own span; filled forward or back inside it, never beyond.

    freq: D, W (Sunday ends), ME or QE; the last value of a period counts.
    """
    ends = {"D": lambda c: c, "W": week_end, "ME": F.last_day, "QE": quarter_end}
    if freq not in ends or method not in ("ffill", "bfill", "none"):
        raise ValueError("freq: D, W, ME or QE; method: ffill, bfill or none")
    periods = series.withColumn("p", ends[freq](F.col("ts"))).groupBy("series_id", "p").agg(_aggregate("last").alias("value"))
    step = {"D": "interval 1 day", "W": "interval 7 days", "ME": "interval 1 month", "QE": "interval 3 months"}[freq]
    span = periods.groupBy("series_id").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    first = F.col("a") if freq in ("D", "W") else F.trunc("a", "month")
    last = F.col("b") if freq in ("D", "W") else F.trunc("b", "month")
    spine = span.select("series_id", F.explode(F.sequence(first, last, F.expr(step))).alias("p"))
    if freq in ("ME", "QE"):
        spine = spine.withColumn("p", F.last_day("p"))
    joined = spine.join(periods, ["series_id", "p"], "left")
    w = W.partitionBy("series_id").orderBy(F.col("p") if method != "bfill" else F.col("p").desc()).rowsBetween(W.unboundedPreceding, 0)
    value = F.col("value") if method == "none" else F.last("value", ignorenulls=True).over(w)
    return joined.select("series_id", F.col("p").alias("ts"), value.alias("value"))


def every_day(series: DataFrame) -> DataFrame:
    """series_id, ts, value on every calendar day; days between carry the observation before, NULL if that is NULL."""
    span = series.groupBy("series_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    spine = span.select("series_id", F.explode(F.sequence("a", "b")).alias("ts"))
    held = series.select("series_id", "ts", F.struct("value").alias("held"))
    w = W.partitionBy("series_id").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    return spine.join(held, ["series_id", "ts"], "left").select("series_id", "ts", F.last("held", ignorenulls=True).over(w)["value"].alias("value"))


def regimes_by_quarter(states: DataFrame, method: str = "mean") -> DataFrame:
    """series_id, quarter, state, p: state probabilities (series_id, ts, state, p) per quarter by mean, last or first."""
    how = {"mean": F.avg("p"), "last": F.max_by("p", "ts"), "first": F.min_by("p", "ts")}
    if method not in how:
        raise ValueError("method: mean, last or first")
    return states.groupBy("series_id", quarter_end(F.col("ts")).alias("quarter"), "state").agg(how[method].alias("p"))


def regime_share_by_week(labels: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """series_id, week (its Sunday) and the share of days under each label."""
    return labels.groupBy("series_id", week_end(F.col("ts")).alias("week")).agg(*[F.avg(F.when(F.col("label") == n, 1.0).otherwise(0.0)).alias(n) for n in names])


def coverage(series: DataFrame, targets: DataFrame) -> DataFrame:
    """series_id, n, nulls, first_day, last_day, freq, quarters_before, quarters_after: how a series covers the target quarters."""
    facts = series.groupBy("series_id").agg(F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"), F.min("ts").alias("first_day"), F.max("ts").alias("last_day"))
    dates = targets.agg(F.collect_set("quarter").alias("dates"))  # one row
    before = F.size(F.filter("dates", lambda d: d < F.col("first_day"))).cast("long")
    after = F.size(F.filter("dates", lambda d: d > F.col("last_day"))).cast("long")
    edged = facts.crossJoin(F.broadcast(dates)).withColumn("quarters_before", before).withColumn("quarters_after", after).drop("dates")
    return edged.join(frequency_class(series), "series_id", "left")
