"""Column expressions over ordered series: returns, differences, scores, calendar and scalar rules."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_series(key: str = "series_id", ts: str = "ts") -> WindowSpec:
    """Rows of one series in time order. A series has at most one row per time step, so it is bounded by its calendar."""
    return W.partitionBy(key).orderBy(ts)


def simple_return(value: str = "value", w: WindowSpec | None = None) -> Column:
    """x over the one before, minus 1; NULL on the first row or where the one before is 0."""
    return F.try_divide(F.col(value), F.lag(value).over(w or by_series())) - 1


def log_return(value: str = "value", w: WindowSpec | None = None) -> Column:
    """ln of x over the one before; NULL unless both are positive."""
    before = F.lag(value).over(w or by_series())
    return F.when((F.col(value) > 0) & (before > 0), F.log(F.col(value) / before))


def difference(value: str = "value", w: WindowSpec | None = None) -> Column:
    """x minus the one before."""
    return F.col(value) - F.lag(value).over(w or by_series())


def z_score(value: str, w: WindowSpec) -> Column:
    """(x - mean) / sample deviation; a deviation of 0 counts as 1."""
    deviation = F.stddev_samp(value).over(w)
    return (F.col(value) - F.avg(value).over(w)) / F.when(deviation == 0, 1.0).otherwise(deviation)


def is_finite(value: Column) -> Column:
    """Neither NULL, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def clipped(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """The value, at least low and at most high."""
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def quarter_end(day: Column) -> Column:
    """Last day of the day's quarter."""
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def parse_quarter(text: Column) -> Column:
    """Quarter end of 2020Q1, 2020 Q1 or 2020-Q1; other texts as dates, NULL if they are none."""
    year, quarter = F.regexp_extract(text, r"(?i)^\s*(\d{4})[\s-]*Q([1-4])\s*$", 1), F.regexp_extract(text, r"(?i)^\s*(\d{4})[\s-]*Q([1-4])\s*$", 2)
    return F.when(year != "", F.last_day(F.make_date(F.try_to_number(year, F.lit("9999")).cast("int"), F.try_to_number(quarter, F.lit("9")).cast("int") * 3, F.lit(1)))).otherwise(F.to_date(F.try_to_timestamp(text)))


def month_of_quarter(day: Column) -> Column:
    """1, 2 or 3."""
    return F.pmod(F.month(day) - 1, F.lit(3)) + 1


def week_end(day: Column) -> Column:
    """The Sunday that ends the day's week."""
    return F.next_day(F.date_sub(day, 1), "SUN")


def asset_class(symbol: Column) -> Column:
    """crypto for symbols ending in -USD or naming a coin, equity for the rest."""
    return F.when(symbol.endswith("-USD") | F.lower(symbol).isin("bitcoin", "ethereum"), "crypto").otherwise("equity")


def horizon_days(code: Column) -> Column:
    """Days of 1D, 7D, 14D or 30D; 7 for anything else."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in (("1D", 1), ("7D", 7), ("14D", 14), ("30D", 30)) for x in pair])[code], F.lit(7))


def annualised_volatility(value: str, w: WindowSpec, rows: int = 30, periods: float = 252.0) -> Column:
    """Sample deviation of the last rows values times the root of periods; NULL before there are as many."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(frame) == rows, F.stddev_samp(value).over(frame) * F.sqrt(F.lit(periods)))
