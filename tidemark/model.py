"""Table access and the NaN-to-NULL boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usable(value: Column | str) -> Column:
    """The value as double, NULL where it is NULL or NaN."""
    value = F.col(value) if isinstance(value, str) else value
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def finite(value: Column | str) -> Column:
    """The value as double, NULL where it is NULL, NaN or infinite."""
    value = F.col(value) if isinstance(value, str) else value
    value = value.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a timestamp meant as UTC."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def epoch_day(ts: Column | str) -> Column:
    """Days since 1970-01-01 of a date or timestamp meant as UTC."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_date(ts.cast("date"))


def day_text(day: Column) -> Column:
    """yyyy-mm-dd of a count of days since 1970-01-01."""
    return F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM-dd")
