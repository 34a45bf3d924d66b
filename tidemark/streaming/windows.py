"""Structured Streaming: windowed aggregates with watermarks, sessions, and a stateful filter per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    """A stream over the Parquet files of a folder; ts is cast to a zoned timestamp, which watermarks need."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, key: str, value: str, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """start, key, n, total, low, high, last per window; events later than late are dropped by the watermark."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), key)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"), F.max_by(value, "ts").alias("last")).select(F.col("window.start").alias("start"), key, "n", "total", "low", "high", "last")


def sliding(events: DataFrame, key: str, value: str, width: str = "1 day", step: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """start, key, n, mean, sd per overlapping window."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), key)
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).select(F.col("window.start").alias("start"), key, "n", "mean", "sd")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """start, stop, key, n: bursts of a key's events with no gap of that length."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), key)
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("stop"), key, "n")


def local_level(events: DataFrame, key: str, value: str, h: float = 1.0, q: float = 0.1, kind: str = "string") -> DataFrame:
    """key, n, level, variance after each micro-batch: a Kalman filter whose state lives in the state store.

    Events of a batch are taken in time order; late ones are filtered in when they come.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, a, p = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(batches)).dropna(subset=[value]).sort_values("ts")
        for y in rows[value]:
            if n == 0:
                a, p = float(y), h
            else:
                p += q
                gain = p / (p + h)
                a, p = a + gain * (float(y) - a), p * (1 - gain)
            n += 1
        state.update((n, a, p))
        yield pd.DataFrame({key: [k[0]], "n": [n], "level": [a], "variance": [p]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, level double, variance double", "n long, level double, variance double", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a bounded stream to its end into a memory table and give that table; for tests and small jobs."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
