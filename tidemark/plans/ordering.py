"""Queries on ordered series: autocorrelation, tests, embeddings, folds, runs, entropies, fractional differencing."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.series import by_series, simple_return
from tidemark.operators import fracdiff, ordered
from tidemark.plans.base import CLOSES, REGIMES, Registry, closes, regimes, shown

R = Registry()
W_ = "WINDOW w AS (PARTITION BY series_id ORDER BY ts)"
LAGS = 40
ACF = f"""{CLOSES}, pos AS (SELECT series_id, ts, value, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n, value - avg(value) OVER (PARTITION BY series_id) AS c FROM closes {W_}),
acf AS (SELECT a.series_id, any_value(a.n) AS n, g.lag, sum(a.c * b.c) / any_value(v.s) AS acf FROM pos a CROSS JOIN generate_series(0, {LAGS}) g(lag)
  JOIN pos b ON b.series_id = a.series_id AND b.pos = a.pos - g.lag JOIN (SELECT series_id, sum(c * c) AS s FROM pos GROUP BY 1 HAVING sum(c * c) > 0) v ON v.series_id = a.series_id GROUP BY a.series_id, g.lag)"""


@R.query("acf_10", f"WITH {ACF} SELECT series_id, n, CAST(lag AS INTEGER) AS lag, round_even(acf, 6) AS acf FROM acf WHERE lag <= 10")
def acf_10(spark, sf_dir):
    """Autocorrelation at lags 0 to 10."""
    return shown(ordered.autocorrelation(closes(spark, sf_dir), 10))


@R.query("ljung_box_q", f"WITH {ACF} SELECT series_id, n, CAST(10 AS INTEGER) AS m, round_even(any_value(n * (n + 2)) * sum(acf * acf / (n - lag)), 4) AS q FROM acf WHERE lag BETWEEN 1 AND 10 GROUP BY 1, 2")
def ljung_box_q(spark, sf_dir):
    """Ljung-Box statistic of ten lags."""
    return shown(ordered.ljung_box(ordered.autocorrelation(closes(spark, sf_dir), 10), 10).drop("p"), 4)


@R.query("ljung_box_p", f"""WITH {ACF}, q AS (SELECT series_id, n, 10 AS m, any_value(n * (n + 2)) * sum(acf * acf / (n - lag)) AS q FROM acf WHERE lag BETWEEN 1 AND 10 GROUP BY 1, 2)
SELECT series_id, n, CAST(m AS INTEGER) AS m, round_even(q, 6) AS q, round_even(exp(-q / 2) * (1 + q / 2 + (q / 2) ** 2 / 2 + (q / 2) ** 3 / 6 + (q / 2) ** 4 / 24), 6) AS p FROM q""")
def ljung_box_p(spark, sf_dir):
    """Its p-value, from the chi-square tail."""
    return shown(ordered.ljung_box(ordered.autocorrelation(closes(spark, sf_dir), 10), 10))


@R.query("seasonal_lag", f"""WITH {ACF} SELECT series_id, CAST(coalesce(min(CASE WHEN lag >= 6 AND lag <= least(40, n // 3) AND abs(acf) > 2 / sqrt(n::DOUBLE) THEN lag END), 0) AS INTEGER) AS lag,
round_even(avg(CASE WHEN lag >= 1 AND lag <= least(5, n // 3) THEN abs(acf) END), 6) AS strength FROM acf GROUP BY 1""")
def seasonal_lag(spark, sf_dir):
    """First significant seasonal lag and autocorrelation strength."""
    acf = ordered.autocorrelation(closes(spark, sf_dir), LAGS)
    return shown(ordered.seasonality(acf).fillna(0, ["lag"]).join(ordered.autocorrelation_strength(acf), "series_id"))


@R.query("noise_trend_outlier", f"""WITH {CLOSES}, p AS (SELECT series_id, value, row_number() OVER w - 1 AS pos, abs(value - avg(value) OVER s) / (stddev_pop(value) OVER s + 1e-12) AS z FROM closes WINDOW w AS (PARTITION BY series_id ORDER BY ts), s AS (PARTITION BY series_id))
SELECT series_id, round_even(regr_slope(value, pos), 6) AS slope, round_even(regr_r2(value, pos), 6) AS r2, round_even(avg(CASE WHEN z > 3 THEN 1.0 ELSE 0.0 END), 6) AS outliers FROM p GROUP BY 1""")
def noise_trend_outlier(spark, sf_dir):
    """Trend regression and share of outliers."""
    return shown(ordered.trend_and_noise(closes(spark, sf_dir)))


@R.query("nsr", f"WITH {CLOSES}, d AS (SELECT series_id, value, value - lag(value) OVER w AS d FROM closes {W_}) SELECT series_id, round_even(var_pop(d) / nullif(var_pop(value), 0), 6) AS nsr FROM d GROUP BY 1")
def nsr(spark, sf_dir):
    """Noise-to-signal ratio."""
    return shown(ordered.noise_to_signal(closes(spark, sf_dir)))


@R.query("should_filter")
def should_filter(spark, sf_dir):
    """The whole decision, with the Ljung-Box p-value of the differences."""
    return shown(ordered.should_filter(closes(spark, sf_dir), 7))


@R.query("filter_metrics", f"""WITH {CLOSES}, p AS (SELECT series_id, value AS o, avg(value) OVER f AS flt, value - avg(value) OVER f AS res FROM closes WINDOW f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT series_id, round_even(10 * log10(var_pop(flt) / nullif(var_pop(res), 0)), 5) AS snr_db, round_even((1 - var_pop(res) / nullif(var_pop(o), 0)) * 100, 5) AS dominance,
  round_even(var_pop(o), 5) AS variance_original, round_even(var_pop(flt), 5) AS variance_filtered, round_even(var_pop(res), 5) AS variance_residual FROM p GROUP BY 1""")
def filter_metrics(spark, sf_dir):
    """M6: signal-to-noise ratio and dominance of a moving average."""
    smooth = F.avg("value").over(by_series().rowsBetween(-4, 0))
    parts = closes(spark, sf_dir).select("series_id", F.col("value").alias("original"), smooth.alias("filtered"), (F.col("value") - smooth).alias("residual"))
    return shown(ordered.filter_metrics(parts), 5)


@R.query("rolling_volatility", f"WITH {CLOSES}, r AS (SELECT series_id, ts, value / nullif(lag(value) OVER w, 0) - 1 AS r FROM closes {W_}) SELECT series_id, CAST(ts AS VARCHAR) AS ts, round_even(CASE WHEN count(r) OVER f = 30 THEN stddev_samp(r) OVER f * sqrt(252.0) END, 6) AS volatility FROM r WINDOW f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def rolling_volatility(spark, sf_dir):
    """Annualised 30-day volatility."""
    from tidemark.functions.series import annualised_volatility

    return shown(closes(spark, sf_dir).withColumn("r", simple_return()).select("series_id", "ts", annualised_volatility("r", by_series()).alias("volatility")))


@R.query("drawdown", f"WITH {CLOSES}, r AS (SELECT series_id, ts, greatest(coalesce(value / nullif(lag(value) OVER w, 0) - 1, 0), -0.999999) AS r FROM closes {W_}), g AS (SELECT *, exp(sum(ln(1 + r)) OVER w) AS g FROM r {W_}) SELECT series_id, CAST(ts AS VARCHAR) AS ts, round_even((g - max(g) OVER w) / max(g) OVER w, 6) AS drawdown FROM g {W_}")
def drawdown(spark, sf_dir):
    """Distance from the running maximum."""
    return shown(ordered.drawdown(closes(spark, sf_dir)))


@R.query("run_length", f"""WITH {REGIMES}, l AS (SELECT series_id, arg_max(label, ts) AS final FROM labels GROUP BY 1), b AS (SELECT series_id, final, max(CASE WHEN label <> final THEN ts END) AS broke FROM labels JOIN l USING (series_id) GROUP BY 1, 2)
SELECT series_id, final AS label, count_if(broke IS NULL OR ts > broke) AS days FROM labels JOIN b USING (series_id) GROUP BY 1, 2""")
def run_length(spark, sf_dir):
    """Days in the regime at the end."""
    return ordered.final_run(regimes(spark, sf_dir))


@R.query("transitions", f"WITH {REGIMES} SELECT series_id, CAST(ts AS VARCHAR) AS ts, label, coalesce(label <> lag(label) OVER w, false) AS changed FROM labels {W_}")
def transitions(spark, sf_dir):
    """Regime changes."""
    return shown(ordered.transitions(regimes(spark, sf_dir)))


@R.query("lag_matrix", f"""WITH {CLOSES}, p AS (SELECT series_id, ts, value AS y, CAST(day(ts) AS DOUBLE) AS x FROM closes), m AS (SELECT series_id, ts, y, lag(y, 1) OVER w AS y1, lag(y, 2) OVER w AS y2, lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x2 FROM p {W_})
SELECT series_id, CAST(ts AS VARCHAR) AS ts, y, y1, y2, x1, x2 FROM m WHERE y1 IS NOT NULL AND y2 IS NOT NULL""")
def lag_matrix(spark, sf_dir):
    """Target and source lags."""
    pairs = closes(spark, sf_dir).select("series_id", "ts", F.col("value").alias("y"), F.dayofmonth("ts").cast("double").alias("x"))
    return shown(ordered.lag_matrix(pairs, 2))


@R.query("delay_embedding", f"WITH {CLOSES}, p AS (SELECT series_id, ts, lag(value, 2) OVER w AS v0, lag(value, 1) OVER w AS v1, value AS v2 FROM closes {W_}) SELECT series_id, CAST(ts AS VARCHAR) AS ts, v0, v1, v2 FROM p WHERE v0 IS NOT NULL")
def delay_embedding(spark, sf_dir):
    """Delay vectors of three values."""
    v = ordered.delay_embedding(closes(spark, sf_dir), 3, 1)
    return shown(v.select("series_id", "ts", *[F.col("vector")[k].alias(f"v{k}") for k in range(3)]))


@R.query("ts_folds", f"""WITH {CLOSES}, p AS (SELECT series_id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM closes {W_}),
f AS (SELECT series_id, CAST(CASE WHEN n // 6 > 0 AND pos >= n - (n // 6) * 5 THEN (pos - (n - (n // 6) * 5)) // (n // 6) + 1 END AS INTEGER) AS fold, pos FROM p)
SELECT series_id, coalesce(fold, 0) AS fold, count(*) AS rows, min(pos) AS first_pos, max(pos) AS last_pos FROM f GROUP BY 1, 2""")
def ts_folds(spark, sf_dir):
    """Expanding folds."""
    f = ordered.expanding_folds(ordered.positioned(closes(spark, sf_dir))).fillna(0, ["fold"])
    return f.groupBy("series_id", "fold").agg(F.count(F.lit(1)).alias("rows"), F.min("pos").cast("long").alias("first_pos"), F.max("pos").cast("long").alias("last_pos"))


@R.query("sample_entropy", f"""WITH {CLOSES}, p AS (SELECT series_id, value, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n, ts FROM closes {W_}),
l AS (SELECT series_id, value, ts, row_number() OVER w - 1 AS k, count(*) OVER s AS size, 0.2 * stddev_pop(value) OVER s AS r FROM p WINDOW w AS (PARTITION BY series_id ORDER BY ts), s AS (PARTITION BY series_id)),
t AS (SELECT * FROM (SELECT series_id, k, size, r, value AS v0, lead(value, 1) OVER w AS v1, lead(value, 2) OVER w AS v2 FROM l {W_}) WHERE k < size - 2),
m AS (SELECT a.series_id, count(*) AS b_n, count_if(abs(a.v2 - b.v2) <= a.r) AS a_n FROM t a JOIN t b ON a.series_id = b.series_id AND a.k < b.k AND abs(a.v0 - b.v0) <= a.r AND abs(a.v1 - b.v1) <= a.r GROUP BY 1)
SELECT series_id, round_even(CASE WHEN a_n > 0 AND b_n > 0 THEN -ln(a_n::DOUBLE / b_n) END, 6) AS entropy FROM (SELECT DISTINCT series_id FROM closes) LEFT JOIN m USING (series_id)""")
def sample_entropy(spark, sf_dir):
    """Sample entropy of every whole series."""
    return shown(ordered.sample_entropy(closes(spark, sf_dir)))


@R.query("hurst_like_slope", f"""WITH {CLOSES}, p AS (SELECT series_id, value, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM closes {W_}),
s AS (SELECT a.series_id, any_value(a.n) AS n, g.lag, stddev_pop(a.value - b.value) AS s FROM p a CROSS JOIN generate_series(2, 19) g(lag) JOIN p b ON a.series_id = b.series_id AND b.pos = a.pos - g.lag GROUP BY 1, 3),
h AS (SELECT series_id, CASE WHEN count(*) >= 2 THEN regr_slope(ln(sqrt(s)), ln(lag::DOUBLE)) END AS slope FROM s WHERE lag < least(20, n // 2) AND s > 0 GROUP BY 1)
SELECT series_id, round_even(coalesce(slope, 0.5), 6) AS slope FROM (SELECT DISTINCT series_id FROM closes) LEFT JOIN h USING (series_id)""")
def hurst_like_slope(spark, sf_dir):
    """Scaling of lagged differences."""
    return shown(ordered.hurst_slope(closes(spark, sf_dir)))


@R.query("entropy_hist20", f"""WITH {CLOSES}, r AS (SELECT series_id, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS a, CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS b, count(*) AS n FROM closes GROUP BY 1),
h AS (SELECT series_id, least(19, floor((value - a) / ((b - a) / 20))) AS bin, count(*) / (any_value(n) * any_value((b - a) / 20)) AS h FROM closes JOIN r USING (series_id) GROUP BY 1, 2)
SELECT series_id, round_even(-sum(h * ln(h)), 5) AS entropy FROM h GROUP BY 1""")
def entropy_hist20(spark, sf_dir):
    """Histogram entropy with 20 bins."""
    return shown(ordered.histogram_entropy(closes(spark, sf_dir)), 5)


@R.query("demo_features", f"""WITH {CLOSES}, r AS (SELECT series_id, ts, value / nullif(lag(value) OVER w, 0) - 1 AS r FROM closes {W_}) SELECT series_id, CAST(ts AS VARCHAR) AS ts, round_even(lag(r, 1) OVER w, 6) AS r1, round_even(lag(r, 2) OVER w, 6) AS r2, round_even(lag(r, 5) OVER w, 6) AS r5,
round_even(stddev_samp(r) OVER f, 6) AS vol5 FROM r WINDOW w AS (PARTITION BY series_id ORDER BY ts), f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def demo_features(spark, sf_dir):
    """Return lags and five-row volatility."""
    w = by_series()
    r = closes(spark, sf_dir).withColumn("r", simple_return())
    return shown(r.select("series_id", "ts", *[F.lag("r", k).over(w).alias(f"r{k}") for k in (1, 2, 5)], F.stddev_samp("r").over(w.rowsBetween(-4, 0)).alias("vol5")))


@R.query("sma20_baseline", f"""WITH {CLOSES}, p AS (SELECT series_id, value, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM closes {W_}), s AS (SELECT *, floor(n * 0.8) AS cut FROM p)
SELECT series_id, count_if(pos < cut) AS train_rows, count_if(pos >= cut) AS test_rows, round_even(avg(CASE WHEN pos < cut AND pos >= cut - 20 THEN value END), 6) AS forecast FROM s GROUP BY 1""")
def sma20_baseline(spark, sf_dir):
    """Chronological split and the mean of the last 20 training rows."""
    s = ordered.chronological_split(ordered.positioned(closes(spark, sf_dir))).withColumn("cut", F.floor(F.col("n") * 0.8))
    train = F.col("part") == "train"
    return shown(s.groupBy("series_id").agg(F.count_if(train).alias("train_rows"), F.count_if(~train).alias("test_rows"), F.avg(F.when(train & (F.col("pos") >= F.col("cut") - 20), F.col("value"))).alias("forecast")))


def _ffd_sql(d: float, threshold: float) -> str:
    weights = fracdiff.ffd_weights(d, threshold)
    terms = " + ".join(f"({w!r}) * lag(value, {len(weights) - 1 - k}) OVER w" for k, w in enumerate(weights))
    return f"SELECT series_id, ts, {terms} AS v FROM closes {W_}"


@R.query("ffd_d04", f"WITH {CLOSES}, f AS ({_ffd_sql(0.4, 1e-2)}) SELECT series_id, CAST(ts AS VARCHAR) AS ts, round_even(v, 5) AS value FROM f WHERE v IS NOT NULL")
def ffd_d04(spark, sf_dir):
    """Fractional differencing of order 0.4."""
    return shown(fracdiff.frac_diff(closes(spark, sf_dir), 0.4, 1e-2), 5)


GRID = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
GRID_SQL = " UNION ALL ".join(
    f"SELECT series_id, {d!r}::DOUBLE AS d, count(*) AS n, corr(v, c.value) AS corr FROM ({_ffd_sql(d, 1e-2) if d else 'SELECT series_id, ts, value AS v FROM closes'}) f JOIN closes c USING (series_id, ts) WHERE v IS NOT NULL GROUP BY 1" for d in GRID
)


@R.query("ffd_corr_grid", f"WITH {CLOSES} SELECT series_id, d, n, round_even(corr, 5) AS corr FROM ({GRID_SQL})")
def ffd_corr_grid(spark, sf_dir):
    """M2: correlation of the differenced with the original series over a grid of orders."""
    return shown(fracdiff.correlation_grid(closes(spark, sf_dir), GRID), 5)


@R.query("sorted_rank", f"WITH {CLOSES}, a AS (SELECT series_id, avg(value) AS mean, count(*) AS n FROM closes GROUP BY 1) SELECT series_id, round_even(mean, 6) AS mean, n, row_number() OVER (ORDER BY mean DESC, series_id) AS rank FROM a ORDER BY rank LIMIT 30")
def sorted_rank(spark, sf_dir):
    """Sort and top 30."""
    a = closes(spark, sf_dir).groupBy("series_id").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    top = a.orderBy(F.desc("mean"), "series_id").limit(30)
    return shown(top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("mean"), "series_id")).cast("long")))
