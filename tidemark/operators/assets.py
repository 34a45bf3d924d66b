"""Comparison of several assets: correlations, relative strength, and joins of series with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.series import simple_return


def daily_returns(series: DataFrame) -> DataFrame:
    """series_id, ts, r: simple returns, without the first row."""
    return series.select("series_id", "ts", simple_return().alias("r")).where("r is not null")


def correlations(returns: DataFrame, names: list[str], complete: bool = False) -> DataFrame:
    """i, j, corr, n: each of the named assets with every series, on the days both have (complete: all named ones have).

    The named assets are a stated set; the full matrix of a few assets is names = all of them. Series meet through the day.
    """
    if complete:
        full = returns.where(F.col("series_id").isin(names)).groupBy("ts").agg(F.count_distinct("series_id").alias("k")).where(F.col("k") == len(set(names)))
        returns = returns.join(full.select("ts"), "ts", "left_semi")
    a, b = returns.where(F.col("series_id").isin(names)).alias("a"), returns.alias("b")
    return a.join(b, F.col("a.ts") == F.col("b.ts")).groupBy(F.col("a.series_id").alias("i"), F.col("b.series_id").alias("j")).agg(F.corr("a.r", "b.r").alias("corr"), F.count(F.lit(1)).alias("n"))


def relative_strength(returns: DataFrame, rows: int = 30) -> DataFrame:
    """series_id, strength: compounded return of the last rows; returns of -1 or less give -1."""
    last = returns.withColumn("k", F.row_number().over(W.partitionBy("series_id").orderBy(F.desc("ts")))).where(F.col("k") <= rows)
    return last.groupBy("series_id").agg(F.when(F.min("r") <= -1, -1.0).otherwise(F.exp(F.sum(F.when(F.col("r") > -1, F.log1p("r")))) - 1).alias("strength"))


def spread(long: DataFrame, first: str, second: str, key: str = "series_id") -> DataFrame:
    """ts, spread: first minus second on the days both have."""
    a = long.where(F.col(key) == first).select("ts", F.col("value").alias("a"))
    b = long.where(F.col(key) == second).select("ts", F.col("value").alias("b"))
    return a.join(b, "ts").select("ts", (F.col("a") - F.col("b")).alias("spread"))


def outer_merged(long: DataFrame, names: list[str], key: str = "series_id") -> DataFrame:
    """ts and one column per name on the union of their days: one pivot instead of a chain of full outer joins."""
    return long.where(F.col(key).isin(names)).groupBy("ts").pivot(key, names).agg(F.first("value", ignorenulls=True))
