"""Statistics of labelled regimes, their order, and names for unnamed states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The regime names, in the order in which fewer than four states are named.
REGIMES = ("bull", "bear", "crisis", "sideways")


def regime_statistics(values: DataFrame, label: str = "label") -> DataFrame:
    """series_id, label, mean, std, min, max, n, proportion of the values under each label."""
    s = values.groupBy("series_id", label).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"))
    return s.withColumn("proportion", F.col("n") / F.sum("n").over(W.partitionBy("series_id")))


def order_by_volatility(statistics: DataFrame, label: str = "label") -> DataFrame:
    """Adds state: 0 for the label with the least deviation; missing deviations last, ties by label."""
    return statistics.withColumn("state", F.row_number().over(W.partitionBy("series_id").orderBy(F.asc_nulls_last("std"), label)) - 1)


def name_states(statistics: DataFrame) -> DataFrame:
    """series_id, state, name from state, mean and std of returns.

    Four states or more, by rising variance: the calmest is bull if it gains and sideways if not; the second is sideways
    after a bull, else bull or bear by its mean; the wildest is crisis if it loses, else bear; each one between gets the
    first of bear, sideways, bull, crisis still free (NULL if none is). Fewer states are named in the order of REGIMES.
    """
    ranked = statistics.select("series_id", "state", "mean", F.coalesce(F.pow("std", 2), F.lit(0.0)).alias("var"))
    w = W.partitionBy("series_id")
    ranked = ranked.withColumn("rank", F.row_number().over(w.orderBy("var", "state"))).withColumn("k", F.count(F.lit(1)).over(w))
    calm_gain = F.max(F.when(F.col("rank") == 1, F.col("mean") > 0)).over(w)
    gain = F.col("mean") > 0
    fixed = (
        F.when(F.col("k") < 4, F.element_at(F.array(*[F.lit(n) for n in REGIMES]), F.least(F.col("rank"), F.lit(4))))
        .when(F.col("rank") == 1, F.when(calm_gain, "bull").otherwise("sideways"))
        .when(F.col("rank") == 2, F.when(calm_gain, "sideways").when(gain, "bull").otherwise("bear"))
        .when(F.col("rank") == F.col("k"), F.when(F.col("mean") < 0, "crisis").otherwise("bear"))
    )
    named = ranked.withColumn("fixed", fixed).withColumn("used", F.collect_set("fixed").over(w))
    free = F.array_except(F.array(*[F.lit(n) for n in ("bear", "sideways", "bull", "crisis")]), F.col("used"))
    place = F.col("rank") - 2  # the first state between is the third
    return named.select("series_id", "state", F.coalesce("fixed", F.get(free, place - 1)).alias("name"))


def transition_counts(labels: DataFrame) -> DataFrame:
    """series_id, i, j, p: share of the days under i that are followed by j."""
    w = W.partitionBy("series_id").orderBy("ts")
    moves = labels.select("series_id", F.col("label").alias("i"), F.lead("label").over(w).alias("j")).where("j is not null")
    counted = moves.groupBy("series_id", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("series_id", "i", "j", (F.col("n") / F.sum("n").over(W.partitionBy("series_id", "i"))).alias("p"))
