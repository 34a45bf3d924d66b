"""Queries on sources, scalars, alignment and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.series import annualised_volatility, asset_class, by_series, difference, horizon_days, is_finite, log_return, parse_quarter, quarter_end, simple_return, z_score
from tidemark.model import table
from tidemark.operators import align
from tidemark.plans.base import CLOSES, PANEL, REGIMES, Registry, closes, order_prices, panel_series, regimes, shown

R = Registry()
QE = "last_day(CAST(date_trunc('quarter', ts) + INTERVAL 2 MONTH AS DATE))"
W_ = "WINDOW w AS (PARTITION BY series_id ORDER BY ts)"
ORDER_DAYS = """days AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ts, CAST(sum(CAST(o_totalprice AS DECIMAL(28,2))) AS DOUBLE) / count(o_totalprice) AS value FROM orders GROUP BY 1, 2)"""


@R.query("slice0_returns_vol_drawdown", f"""WITH {ORDER_DAYS},
r AS (SELECT *, ln(value / lag(value) OVER w) AS log_return, value / lag(value) OVER w - 1 AS simple FROM days {W_}),
c AS (SELECT *, CASE WHEN count(log_return) OVER f = 30 THEN stddev_samp(log_return) OVER f * sqrt(252.0) END AS volatility,
      exp(sum(ln(1 + coalesce(simple, 0))) OVER w) AS grown FROM r WINDOW w AS (PARTITION BY series_id ORDER BY ts), f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT series_id, CAST(ts AS VARCHAR) AS ts, round_even(log_return, 6) AS log_return, round_even(volatility, 6) AS volatility,
  round_even((grown - max(grown) OVER w) / max(grown) OVER w, 6) AS drawdown FROM c {W_}""")  # fmt: skip
def slice0(spark, sf_dir):
    """Daily order prices: log return, 30-day volatility and drawdown."""
    w = by_series()
    r = order_prices(spark, sf_dir).withColumn("log_return", log_return()).withColumn("simple", simple_return())
    r = r.withColumn("volatility", annualised_volatility("log_return", w)).withColumn("grown", F.exp(F.sum(F.log(1 + F.coalesce("simple", F.lit(0.0)))).over(w)))
    top = F.max("grown").over(w)
    return shown(r.select("series_id", "ts", "log_return", "volatility", ((F.col("grown") - top) / top).alias("drawdown")))


@R.query("simple_returns", f"WITH {CLOSES} SELECT series_id, CAST(ts AS VARCHAR) AS ts, round_even(value / nullif(lag(value) OVER w, 0) - 1, 6) AS ret, round_even(value - lag(value) OVER w, 6) AS diff FROM closes {W_}")
def simple_returns(spark, sf_dir):
    """Simple return and first difference of every close."""
    return shown(closes(spark, sf_dir).select("series_id", "ts", simple_return().alias("ret"), difference().alias("diff")))


@R.query("zscore_by_series", f"WITH {CLOSES} SELECT series_id, CAST(ts AS VARCHAR) AS ts, round_even((value - avg(value) OVER s) / CASE WHEN stddev_samp(value) OVER s = 0 THEN 1 ELSE stddev_samp(value) OVER s END, 6) AS z FROM closes WINDOW s AS (PARTITION BY series_id)")
def zscore_by_series(spark, sf_dir):
    """Z-score within the series."""
    from pyspark.sql import Window as W

    return shown(closes(spark, sf_dir).select("series_id", "ts", z_score("value", W.partitionBy("series_id")).alias("z")))


@R.query("asset_routing", """SELECT symbol, CASE WHEN symbol LIKE '%-USD' OR lower(symbol) IN ('bitcoin', 'ethereum') THEN 'crypto' ELSE 'equity' END AS asset_class, 7 AS horizon FROM (SELECT DISTINCT symbol FROM ohlcv WHERE symbol IS NOT NULL)""")
def asset_routing(spark, sf_dir):
    """Which loader a symbol belongs to; unknown horizon codes mean 7 days."""
    symbols = table(spark, sf_dir, "ohlcv").where("symbol is not null").select("symbol").distinct()
    return symbols.select("symbol", asset_class(F.col("symbol")).alias("asset_class"), horizon_days(F.lit("5Y")).alias("horizon"))


@R.query("finite_rows", "SELECT count(*) AS n, count_if(close IS NOT NULL AND NOT isnan(close) AND NOT isinf(close)) AS finite, count_if(open IS NOT NULL AND close IS NOT NULL) AS both_there, count_if(open IS NOT NULL OR close IS NOT NULL) AS any_there FROM ohlcv")
def finite_rows(spark, sf_dir):
    """Rows that survive the finite check and the two ways of dropping NULLs."""
    bars = table(spark, sf_dir, "ohlcv")
    return bars.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_finite(F.col("close"))).alias("finite"), F.count_if(F.col("open").isNotNull() & F.col("close").isNotNull()).alias("both_there"), F.count_if(F.col("open").isNotNull() | F.col("close").isNotNull()).alias("any_there"))


@R.query("quarter_parse", """SELECT DISTINCT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS text, CAST(last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS VARCHAR) AS quarter_end FROM orders""")
def quarter_parse(spark, sf_dir):
    """S3: quarter strings to quarter ends."""
    texts = table(spark, sf_dir, "orders").select(F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate")).alias("text")).distinct()
    return shown(texts.select("text", parse_quarter(F.col("text")).alias("quarter_end")))


GAP = "(SELECT series_id, count(*) AS n, CASE WHEN count(*) > 1 THEN date_diff('day', min(ts), max(ts))::DOUBLE / (count(*) - 1) END AS gap FROM panel_series GROUP BY series_id)"


@R.query("freq_infer", f"""WITH {PANEL} SELECT series_id, round_even(gap, 6) AS gap, CAST(CASE WHEN n < 2 THEN 1 WHEN gap <= 1.5 THEN 7 WHEN gap <= 8 THEN 52 WHEN gap <= 32 THEN 12 WHEN gap <= 93 THEN 4 ELSE 1 END AS INTEGER) AS period,
CASE WHEN gap <= 8 THEN 'D' WHEN gap <= 32 THEN 'M' ELSE 'Q' END AS freq FROM {GAP}""")
def freq_infer(spark, sf_dir):
    """Seasonal period and frequency class from the mean gap."""
    s = panel_series(spark, sf_dir)
    return shown(align.seasonal_period(s).join(align.frequency_class(s), "series_id"))


HOW = {"last": "arg_max(value, ts)", "mean": "avg(value)", "sum": "coalesce(sum(value), 0)", "first": "arg_min(value, ts)", "min": "min(value)", "max": "max(value)"}


def _quarters(how: str):
    sql = f"""WITH {CLOSES}, q AS (SELECT series_id, {QE} AS quarter, {HOW[how]} AS value FROM closes GROUP BY 1, 2),
spine AS (SELECT series_id, last_day(CAST(unnest(generate_series(date_trunc('month', min(quarter)), date_trunc('month', max(quarter)), INTERVAL 3 MONTH)) AS DATE)) AS quarter FROM q GROUP BY series_id)
SELECT series_id, CAST(quarter AS VARCHAR) AS quarter, round_even({"coalesce(value, 0)" if how == "sum" else "value"}, 4) AS value FROM spine LEFT JOIN q USING (series_id, quarter)"""

    @R.query(f"resample_qe_{how}", sql)
    def run(spark, sf_dir):
        return shown(align.resample_quarters(closes(spark, sf_dir), how), 4)

    run.__doc__ = f"T3: closes to quarter ends by {how}."


for _how in HOW:
    _quarters(_how)


@R.query("resample_to_targets", f"""WITH {CLOSES}, q AS (SELECT series_id, {QE} AS quarter, arg_max(value, ts) AS value FROM closes GROUP BY 1, 2),
t AS (SELECT DISTINCT last_day(CAST(date_trunc('quarter', obs_date) + INTERVAL 2 MONTH AS DATE)) AS quarter FROM panel WHERE obs_date IS NOT NULL)
SELECT s.series_id, CAST(t.quarter AS VARCHAR) AS quarter, round_even(q.value, 4) AS value FROM (SELECT DISTINCT series_id FROM closes) s CROSS JOIN t LEFT JOIN q ON q.series_id = s.series_id AND q.quarter = t.quarter""")
def resample_to_targets(spark, sf_dir):
    """Resampled closes on the panel's quarters."""
    targets = table(spark, sf_dir, "panel").where("obs_date is not null").select(quarter_end(F.col("obs_date")).alias("quarter")).distinct()
    return shown(align.resample_quarters(closes(spark, sf_dir), "last", targets), 4)


@R.query("quarter_stats", f"""WITH {CLOSES} SELECT series_id, CAST({QE} AS VARCHAR) AS quarter, round_even(avg(value), 6) AS mean, round_even(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max, arg_max(value, ts) AS last FROM closes GROUP BY 1, 2""")
def quarter_stats(spark, sf_dir):
    """T4: five statistics per quarter."""
    return shown(align.quarter_statistics(closes(spark, sf_dir)))


MONTHS = ", ".join(f"round_even(avg(value) FILTER (WHERE (month(ts) - 1) % 3 + 1 = {k}), 6) AS m{k}" for k in (1, 2, 3))


@R.query("monthly_to_quarter_pivot", f"WITH {PANEL} SELECT series_id, CAST({QE} AS VARCHAR) AS quarter, {MONTHS} FROM panel_series WHERE freq = 'ME' GROUP BY 1, 2")
def monthly_to_quarter_pivot(spark, sf_dir):
    """T5: the months of a quarter side by side."""
    return shown(align.months_of_quarter(panel_series(spark, sf_dir).where("freq = 'ME'")))


@R.query("mixed_freq_features", f"""WITH {PANEL}, f AS (SELECT series_id, CASE WHEN gap <= 8 THEN 'D' WHEN gap <= 32 THEN 'M' ELSE 'Q' END AS f FROM {GAP}),
p AS (SELECT series_id, f, {QE} AS quarter, ts, value FROM panel_series JOIN f USING (series_id)),
d AS (SELECT series_id, quarter, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, arg_max(value, ts) AS last FROM p WHERE f = 'D' GROUP BY 1, 2),
m AS (SELECT series_id, quarter, {MONTHS.replace('round_even(', '(').replace(', 6)', ')')} FROM p WHERE f = 'M' GROUP BY 1, 2)
SELECT series_id, CAST(quarter AS VARCHAR) AS quarter, feature, round_even(value, 6) AS value FROM (
  SELECT series_id, quarter, unnest(['mean','std','min','max','last']) AS feature, unnest([mean, std, min, max, last]) AS value FROM d
  UNION ALL SELECT series_id, quarter, unnest(['m1','m2','m3']), unnest([m1, m2, m3]) FROM m
  UNION ALL SELECT series_id, quarter, 'value', arg_max(value, ts) FROM p WHERE f = 'Q' GROUP BY 1, 2)""")
def mixed_freq_features(spark, sf_dir):
    """The panel's features on the quarterly index."""
    return shown(align.mixed_frequency_features(panel_series(spark, sf_dir)))


def _aligned(method: str, order: str):
    sql = f"""WITH {CLOSES}, spine AS (SELECT series_id, CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS DATE) AS ts FROM closes GROUP BY series_id)
SELECT series_id, CAST(ts AS VARCHAR) AS ts, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM spine LEFT JOIN closes USING (series_id, ts)"""

    @R.query(f"aligned_{method}", sql)
    def run(spark, sf_dir):
        return shown(align.aligned(closes(spark, sf_dir), "D", method))

    run.__doc__ = f"T7: daily grid inside each series' span, {method}."


_aligned("ffill", "")
_aligned("bfill", "DESC")


@R.query("asfreq_daily_ffill", f"""WITH {CLOSES}, spine AS (SELECT series_id, CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS DATE) AS ts FROM closes GROUP BY series_id)
SELECT s.series_id, CAST(s.ts AS VARCHAR) AS ts, c.value FROM spine s ASOF JOIN closes c ON s.series_id = c.series_id AND s.ts >= c.ts""")
def asfreq_daily_ffill(spark, sf_dir):
    """Every calendar day carries the observation before."""
    return shown(align.every_day(closes(spark, sf_dir)))


@R.query("aligned_monthly_wide", f"""WITH {PANEL}, m AS (SELECT series_id, last_day(ts) AS ts, arg_max(value, ts) AS value FROM panel_series GROUP BY 1, 2)
SELECT CAST(ts AS VARCHAR) AS ts, count(*) AS series, round_even(sum(value), 4) AS total FROM m GROUP BY 1""")
def aligned_monthly_wide(spark, sf_dir):
    """Month-end values of all series on one index, as one union instead of a chain of outer joins."""
    m = align.aligned(panel_series(spark, sf_dir), "ME", "none").where("value is not null")
    return shown(m.groupBy("ts").agg(F.count(F.lit(1)).alias("series"), F.sum("value").alias("total")), 4)


SHARE = ", ".join(f"round_even(avg(CAST(label = '{r}' AS INTEGER)), 6) AS {r}" for r in ("bull", "bear", "crisis", "sideways"))


@R.query("regime_share_weekly", f"WITH {REGIMES} SELECT series_id, CAST(ts + CAST((7 - isodow(ts)) % 7 AS INTEGER) AS VARCHAR) AS week, {SHARE} FROM labels GROUP BY 1, 2")
def regime_share_weekly(spark, sf_dir):
    """Share of days under each regime per week."""
    return shown(align.regime_share_by_week(regimes(spark, sf_dir), ("bull", "bear", "crisis", "sideways")))


@R.query("regime_quarterly", f"""WITH {REGIMES}, p AS (SELECT series_id, ts, s.state, CAST(label = s.state AS INTEGER)::DOUBLE AS p FROM labels, (VALUES ('bull'), ('bear'), ('crisis'), ('sideways')) s(state))
SELECT series_id, CAST({QE} AS VARCHAR) AS quarter, state, round_even(avg(p), 6) AS p FROM p GROUP BY 1, 2, 3""")
def regime_quarterly(spark, sf_dir):
    """State probabilities per quarter."""
    states = F.explode(F.array(*[F.lit(x) for x in ("bull", "bear", "crisis", "sideways")]))
    p = regimes(spark, sf_dir).select("series_id", "ts", "label", states.alias("state")).withColumn("p", F.when(F.col("label") == F.col("state"), 1.0).otherwise(0.0))
    return shown(align.regimes_by_quarter(p))


@R.query("coverage_report", f"""WITH {PANEL}, t AS (SELECT DISTINCT {QE} AS quarter FROM panel_series), g AS {GAP},
f AS (SELECT series_id, count(value) AS n, count_if(value IS NULL) AS nulls, min(ts) AS first_day, max(ts) AS last_day FROM panel_series GROUP BY 1)
SELECT f.series_id, f.n, nulls, CAST(first_day AS VARCHAR) AS first_day, CAST(last_day AS VARCHAR) AS last_day, CASE WHEN gap <= 8 THEN 'D' WHEN gap <= 32 THEN 'M' ELSE 'Q' END AS freq,
  (SELECT count(*) FROM t WHERE quarter < first_day) AS quarters_before, (SELECT count(*) FROM t WHERE quarter > last_day) AS quarters_after FROM f JOIN g USING (series_id)""")
def coverage_report(spark, sf_dir):
    """How each series covers the panel's quarters."""
    s = panel_series(spark, sf_dir)
    return shown(align.coverage(s, s.select(quarter_end(F.col("ts")).alias("quarter"))))


@R.query("ohlcv_from_orders", """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY 1""")
def ohlcv_from_orders(spark, sf_dir):
    """Daily bars of order prices."""
    o = table(spark, sf_dir, "orders")
    bars = o.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count(F.lit(1)).alias("volume")
    )
    return shown(bars)


@R.query("fill_all_null_columns", "SELECT o_orderkey, CASE WHEN count(CASE WHEN o_totalprice < 0 THEN o_totalprice END) OVER () = 0 THEN 0.0 ELSE CASE WHEN o_totalprice < 0 THEN o_totalprice END END AS filled FROM orders")
def fill_all_null_columns(spark, sf_dir):
    """A column without any value becomes 0."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") < 0, F.col("o_totalprice")).alias("x"))
    known = o.agg(F.count("x").alias("known"))
    return o.crossJoin(F.broadcast(known)).select("o_orderkey", F.when(F.col("known") == 0, 0.0).otherwise(F.col("x")).alias("filled"))
