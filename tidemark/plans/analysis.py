"""Queries on joins, aggregates, backtests, regimes and causality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.series import by_series, simple_return
from tidemark.model import table, usable
from tidemark.operators import assets, backtest, causality, ordered, regimes as regime_ops
from tidemark.plans.base import CLOSES, PANEL, REGIMES, Registry, closes, panel_series, regimes, shown

R = Registry()
W_ = "WINDOW w AS (PARTITION BY series_id ORDER BY ts)"
START, END = "2018-01-01", "2024-12-31"
ORIGINS = f"""{CLOSES}, ret AS (SELECT series_id, ts, value, value / nullif(lag(value) OVER w, 0) - 1 AS r, row_number() OVER w AS seen FROM closes {W_}),
facts AS (SELECT *, stddev_samp(r) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS sigma FROM ret),
o AS (SELECT s.series_id, CAST(g.d AS DATE) AS origin FROM (SELECT DISTINCT series_id FROM closes) s CROSS JOIN (SELECT unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 7 DAY)) AS d) g),
oo AS (SELECT o.series_id, origin, f.seen AS history, f.value AS price, f.sigma, a.value AS actual, a.ts AS observed FROM o ASOF JOIN facts f ON o.series_id = f.series_id AND o.origin >= f.ts
  ASOF JOIN (SELECT * FROM closes) a ON o.series_id = a.series_id AND o.origin + 7 >= a.ts),
origins AS (SELECT series_id, origin, history, price, sigma, actual FROM oo WHERE history >= 120 AND observed > origin),
fc AS (SELECT *, price AS forecast, price - 1.96 * price * coalesce(sigma, 0) * sqrt(7.0) AS lower, price + 1.96 * price * coalesce(sigma, 0) * sqrt(7.0) AS upper FROM origins)"""


def _origins(spark, sf_dir):
    return backtest.origins_and_actuals(closes(spark, sf_dir), START, END)


@R.query("backtest_origin_actuals", f"WITH {ORIGINS} SELECT series_id, CAST(origin AS VARCHAR) AS origin, history, price, round_even(sigma, 6) AS sigma, actual FROM origins")
def backtest_origin_actuals(spark, sf_dir):
    """As-of price and last value within the horizon of every origin."""
    return shown(_origins(spark, sf_dir))


@R.query("naive_backtest_metrics", f"""WITH {ORIGINS} SELECT series_id, count(*) AS n, round_even(avg(abs(forecast - actual)), 6) AS mae, round_even(sqrt(avg((forecast - actual) ** 2)), 6) AS rmse, round_even(avg(CASE WHEN actual = 0 THEN 0 ELSE abs(forecast - actual) / abs(actual) * 100 END), 6) AS mape,
round_even(avg(CASE WHEN (actual > price) = (forecast > price) THEN 100.0 ELSE 0 END), 4) AS direction, round_even(avg(CASE WHEN lower <= actual AND actual <= upper THEN 100.0 ELSE 0 END), 4) AS coverage FROM fc GROUP BY 1""")
def naive_backtest_metrics(spark, sf_dir):
    """Persistence with its band, walked forward."""
    m = backtest.error_metrics(backtest.naive_forecasts(_origins(spark, sf_dir)), ["series_id"])
    return shown(m.withColumn("direction", F.bround(F.col("direction") + 3.1e-9, 4)).withColumn("coverage", F.bround(F.col("coverage") + 3.1e-9, 4)))


AT_REGIME = f"""WITH {ORIGINS}, {REGIMES}, rec AS (SELECT fc.*, coalesce(l.label, 'unknown') AS regime FROM fc ASOF LEFT JOIN labels l ON fc.series_id = l.series_id AND fc.origin >= l.ts)"""


@R.query("crisis_counters", AT_REGIME + """, c AS (SELECT series_id, count_if(actual / price - 1 < -0.10) AS actual_crises, count_if(regime = 'crisis' AND actual / price - 1 < -0.05) AS detected, count_if(regime = 'crisis' AND actual / price - 1 > -0.02) AS false_alerts FROM rec GROUP BY 1)
SELECT *, greatest(0, actual_crises - detected)::BIGINT AS missed FROM c""")
def crisis_counters(spark, sf_dir):
    """Crises that happened, were seen, were false or were missed."""
    rec = backtest.with_regime(backtest.naive_forecasts(_origins(spark, sf_dir)), regimes(spark, sf_dir))
    return backtest.crisis_counters(rec, ["series_id"])


@R.query("pipeline_distribution", AT_REGIME + f""", h AS (SELECT series_id, sum(d * lag_d) / nullif(sum(d * d), 0) AS strength FROM (SELECT series_id, value - avg(value) OVER (PARTITION BY series_id) AS d, lag(value) OVER w - avg(value) OVER (PARTITION BY series_id) AS lag_d FROM closes {W_}) GROUP BY 1),
p AS (SELECT rec.series_id, CASE WHEN regime = 'crisis' THEN 'crisis' WHEN NOT (sigma < 0.02) THEN 'aggressive' WHEN strength > 0.3 THEN 'trend_following' ELSE 'conservative' END AS pipeline FROM rec JOIN h USING (series_id))
SELECT series_id, pipeline, round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY series_id), 6) AS share FROM p GROUP BY 1, 2""")
def pipeline_distribution(spark, sf_dir):
    """Share of the pipelines chosen at the origins; here calm counts as stationary, the test itself being a kernel."""
    acf = ordered.autocorrelation(closes(spark, sf_dir), 1).where("lag = 1").select("series_id", F.col("acf").alias("strength"))
    rec = backtest.with_regime(_origins(spark, sf_dir), regimes(spark, sf_dir)).join(acf, "series_id")
    chosen = rec.withColumn("pipeline", backtest.pipeline_choice(F.col("regime"), F.col("sigma") < 0.02, F.col("strength")))
    return shown(backtest.distribution(chosen, "pipeline", ["series_id"]))


@R.query("regime_validation", f"""WITH {CLOSES}, {REGIMES}, r AS (SELECT series_id, ts, value / nullif(lag(value) OVER w, 0) - 1 AS r FROM closes {W_}),
v AS (SELECT series_id, ts, CASE WHEN count(r) OVER f = 30 THEN stddev_samp(r) OVER f * sqrt(252.0) END AS vol, exp(sum(ln(1 + greatest(coalesce(r, 0), -0.999999))) OVER w) AS g FROM r WINDOW w AS (PARTITION BY series_id ORDER BY ts), f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
d AS (SELECT series_id, ts, vol, (g - max(g) OVER w) / max(g) OVER w AS dd FROM v {W_}),
a AS (SELECT series_id, avg(CASE WHEN label = 'crisis' THEN vol END) AS cv, avg(CASE WHEN label <> 'crisis' THEN vol END) AS ov, avg(CASE WHEN label = 'crisis' THEN dd END) AS cd, count_if(label = 'crisis') AS n FROM d JOIN labels USING (series_id, ts) GROUP BY 1)
SELECT series_id, round_even(cv, 6) AS crisis_vol, round_even(ov, 6) AS other_vol, round_even(cd, 6) AS crisis_drawdown, n AS crisis_days, coalesce(cv > ov, true) AS vol_aligned, CASE WHEN n > 5 THEN cd < -0.05 ELSE true END AS drawdown_aligned FROM a""")
def regime_validation(spark, sf_dir):
    """Do crises come with volatility and drawdown?"""
    return shown(backtest.regime_validation(closes(spark, sf_dir), regimes(spark, sf_dir)))


RETURNS = f"r AS (SELECT * FROM (SELECT series_id, ts, value / nullif(lag(value) OVER w, 0) - 1 AS r FROM closes {W_}) WHERE r IS NOT NULL)"


@R.query("corr_matrix", f"WITH {CLOSES}, {RETURNS} SELECT a.series_id AS i, b.series_id AS j, round_even(corr(a.r, b.r), 6) AS corr, count(*) AS n FROM r a JOIN r b USING (ts) WHERE a.series_id = 'QORVEX-USD' GROUP BY 1, 2")
def corr_matrix(spark, sf_dir):
    """Correlations of the named assets with every series, on their common days."""
    return shown(assets.correlations(assets.daily_returns(closes(spark, sf_dir)), ["QORVEX-USD"]))


@R.query("relative_strength_30", f"WITH {CLOSES}, {RETURNS} SELECT series_id, round_even(CASE WHEN min(r) <= -1 THEN -1 ELSE exp(sum(ln(1 + r))) - 1 END, 6) AS strength FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS k FROM r) WHERE k <= 30 GROUP BY 1")
def relative_strength_30(spark, sf_dir):
    """A4: compounded return of the last 30 rows."""
    return shown(assets.relative_strength(assets.daily_returns(closes(spark, sf_dir))))


STATS = f"""WITH {CLOSES}, {REGIMES}, {RETURNS}, s AS (SELECT r.series_id, label, avg(r) AS mean, stddev_samp(r) AS std, min(r) AS min, max(r) AS max, count(r) AS n FROM r JOIN labels USING (series_id, ts) GROUP BY 1, 2)"""


def _stats(spark, sf_dir):
    values = assets.daily_returns(closes(spark, sf_dir)).join(regimes(spark, sf_dir), ["series_id", "ts"]).withColumnRenamed("r", "value")
    return regime_ops.regime_statistics(values)


@R.query("regime_stats_by_label", STATS + " SELECT series_id, label, round_even(mean, 6) AS mean, round_even(std, 6) AS std, round_even(min, 6) AS min, round_even(max, 6) AS max, n, round_even(n / sum(n) OVER (PARTITION BY series_id), 6) AS proportion, CAST(row_number() OVER (PARTITION BY series_id ORDER BY std NULLS LAST, label) - 1 AS INTEGER) AS state FROM s")
def regime_stats_by_label(spark, sf_dir):
    """A1, A2: statistics per regime and their order by deviation."""
    return shown(regime_ops.order_by_volatility(_stats(spark, sf_dir)))


@R.query("named_regimes_from_stats", STATS + """, q AS (SELECT series_id, label, mean, row_number() OVER (PARTITION BY series_id ORDER BY std NULLS LAST, label) AS st, coalesce(std * std, 0) AS var FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY var, st) AS rk, count(*) OVER (PARTITION BY series_id) AS k FROM q),
m AS (SELECT *, max(CASE WHEN rk = 1 THEN mean END) OVER (PARTITION BY series_id) AS m1 FROM k),
f AS (SELECT *, CASE WHEN k < 4 THEN ['bull','bear','crisis','sideways'][rk] WHEN rk = 1 THEN CASE WHEN m1 > 0 THEN 'bull' ELSE 'sideways' END
  WHEN rk = 2 THEN CASE WHEN m1 > 0 THEN 'sideways' WHEN mean > 0 THEN 'bull' ELSE 'bear' END WHEN rk = k THEN CASE WHEN mean < 0 THEN 'crisis' ELSE 'bear' END END AS fixed FROM m),
u AS (SELECT series_id, list(fixed) AS used FROM f GROUP BY 1)
SELECT series_id, CAST(st - 1 AS INTEGER) AS state, coalesce(fixed, [x FOR x IN ['bear','sideways','bull','crisis'] IF NOT list_contains(used, x)][rk - 2]) AS name FROM f JOIN u USING (series_id)""")
def named_regimes_from_stats(spark, sf_dir):
    """Names for states from their mean and variance."""
    return regime_ops.name_states(regime_ops.order_by_volatility(_stats(spark, sf_dir)))


@R.query("transition_matrix", f"WITH {REGIMES}, m AS (SELECT series_id, label AS i, lead(label) OVER w AS j FROM labels {W_}) SELECT series_id, i, j, round_even(count(*) / sum(count(*)) OVER (PARTITION BY series_id, i), 6) AS p FROM m WHERE j IS NOT NULL GROUP BY 1, 2, 3")
def transition_matrix(spark, sf_dir):
    """Transition shares in long form."""
    return shown(regime_ops.transition_counts(regimes(spark, sf_dir)))


@R.query("outer_merge_series", f"""WITH {PANEL}, m AS (SELECT ts, name, avg(value) AS value FROM panel_series GROUP BY 1, 2)
SELECT CAST(ts AS VARCHAR) AS ts, round_even(max(CASE WHEN name = 'PMI' THEN value END), 5) AS "PMI", round_even(max(CASE WHEN name = 'GDP_growth' THEN value END), 5) AS "GDP_growth" FROM m WHERE name IN ('PMI', 'GDP_growth') GROUP BY 1""")
def outer_merge_series(spark, sf_dir):
    """Two series on the union of their days."""
    m = panel_series(spark, sf_dir).groupBy("ts", "name").agg(F.avg("value").alias("value"))
    return shown(assets.outer_merged(m, ["PMI", "GDP_growth"], "name"), 5)


@R.query("inner_spread", f"""WITH {PANEL}, m AS (SELECT ts, name, avg(value) AS value FROM panel_series GROUP BY 1, 2) SELECT CAST(ts AS VARCHAR) AS ts, round_even(a.value - b.value, 5) AS spread FROM m a JOIN m b USING (ts) WHERE a.name = 'PMI' AND b.name = 'cpi_yoy'""")
def inner_spread(spark, sf_dir):
    """Difference of two series on their common days."""
    m = panel_series(spark, sf_dir).groupBy("ts", "name").agg(F.avg("value").alias("value"))
    return shown(assets.spread(m, "PMI", "cpi_yoy", "name"), 5)


@R.query("naive_and_snaive", f"""WITH {CLOSES}, l AS (SELECT series_id, value, lag(value, 1) OVER w AS naive, lag(value, 4) OVER w AS snaive FROM closes {W_}) SELECT series_id, round_even(avg(abs(value - naive)), 6) AS mae_naive, round_even(avg(abs(value - snaive)), 6) AS mae_snaive FROM l GROUP BY 1""")
def naive_and_snaive(spark, sf_dir):
    """Errors of the two naive forecasts."""
    w = by_series()
    l = closes(spark, sf_dir).withColumn("naive", F.lag("value", 1).over(w)).withColumn("snaive", F.lag("value", 4).over(w))
    return shown(l.groupBy("series_id").agg(F.avg(F.abs(F.col("value") - F.col("naive"))).alias("mae_naive"), F.avg(F.abs(F.col("value") - F.col("snaive"))).alias("mae_snaive")))


@R.query("percentile_threshold", f"WITH {CLOSES}, {RETURNS} SELECT series_id, round_even(quantile_cont(r, 0.95), 6) AS p95, round_even(avg(CASE WHEN r >= 0 THEN 1.0 ELSE 0 END), 6) AS share_up FROM r GROUP BY 1")
def percentile_threshold(spark, sf_dir):
    """Exact percentile and empirical share."""
    r = assets.daily_returns(closes(spark, sf_dir))
    return shown(r.groupBy("series_id").agg(F.percentile("r", 0.95).alias("p95"), F.avg(F.when(F.col("r") >= 0, 1.0).otherwise(0.0)).alias("share_up")))


def price_volume(spark, sf_dir):
    """series_id, ts, y (return), x (change of log volume) of every bar day."""
    bars = table(spark, sf_dir, "ohlcv").select(F.col("symbol").alias("series_id"), F.col("ts").cast("date").alias("ts"), usable("close").alias("v"), "volume", "ingested_at", "bar_id").where("series_id is not null and ts is not null and v is not null and volume > 0")
    best = bars.groupBy("series_id", "ts").agg(F.max_by(F.struct("v", "volume"), F.struct("ingested_at", "bar_id")).alias("b")).select("series_id", "ts", F.col("b.v").alias("value"), F.log(F.col("b.volume").cast("double")).alias("x"))
    return best.withColumn("y", simple_return()).where("y is not null").select("series_id", "ts", "y", "x")


PAIRS = f"""bv AS (SELECT symbol AS series_id, CAST(ts AS DATE) AS ts, arg_max({{'v': close, 'vol': volume}}, (coalesce(ingested_at, TIMESTAMP '0001-01-01'), bar_id)) AS b FROM ohlcv
  WHERE symbol IS NOT NULL AND ts IS NOT NULL AND close IS NOT NULL AND NOT isnan(close) AND volume > 0 GROUP BY 1, 2),
pairs AS (SELECT * FROM (SELECT series_id, ts, b.v / nullif(lag(b.v) OVER w, 0) - 1 AS y, ln(b.vol::DOUBLE) AS x FROM bv {W_}) WHERE y IS NOT NULL)"""


@R.query("ccm_score", f"""WITH {PAIRS}, rec AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS back FROM pairs),
p AS (SELECT series_id, x, row_number() OVER w AS pos, lag(y, 2) OVER w AS v0, lag(y, 1) OVER w AS v1, y AS v2 FROM rec {W_}), q AS (SELECT * FROM p WHERE pos > 2),
n AS (SELECT a.series_id, a.pos, a.x, b.x AS found, row_number() OVER (PARTITION BY a.series_id, a.pos ORDER BY (a.v0 - b.v0) ** 2 + (a.v1 - b.v1) ** 2 + (a.v2 - b.v2) ** 2, b.pos) AS rk FROM q a JOIN q b ON a.series_id = b.series_id AND a.pos <> b.pos),
m AS (SELECT series_id, pos, any_value(x) AS x, avg(found) AS pr FROM n WHERE rk <= 4 GROUP BY 1, 2), s AS (SELECT series_id, count(*) AS points, corr(x, pr) AS c FROM m GROUP BY 1)
SELECT series_id, points, round_even(CASE WHEN points + 2 >= 8 AND c > 0 THEN c ELSE 0 END, 5) AS score FROM s""")
def ccm_score(spark, sf_dir):
    """Cross map from returns to volume."""
    return shown(causality.cross_map_score(price_volume(spark, sf_dir)), 5)


@R.query("granger_ridge_1lag", f"""WITH {PAIRS}, l AS (SELECT * FROM (SELECT series_id, ts, y, lag(y) OVER w AS a, lag(x) OVER w AS b FROM pairs {W_}) WHERE a IS NOT NULL AND b IS NOT NULL),
p AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM l {W_}),
f AS (SELECT *, CASE WHEN pos < n - (n // 6) * 5 THEN 0 ELSE (pos - (n - (n // 6) * 5)) // (n // 6) + 1 END AS fold FROM p),
m AS (SELECT t.series_id, g.fold, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(y, a) * count(*) AS ya, covar_pop(y, b) * count(*) AS yb, var_pop(a) * count(*) + 1 AS aa, covar_pop(a, b) * count(*) AS ab, var_pop(b) * count(*) + 1 AS bb
  FROM f t JOIN generate_series(1, 5) g(fold) ON t.fold < g.fold GROUP BY 1, 2),
e AS (SELECT f.series_id, f.fold, avg((y - my - ya / aa * (a - ma)) ** 2) AS uni, avg((y - my - (ya * bb - yb * ab) / (aa * bb - ab * ab) * (a - ma) - (yb * aa - ya * ab) / (aa * bb - ab * ab) * (b - mb)) ** 2) AS bi FROM f JOIN m ON f.series_id = m.series_id AND f.fold = m.fold GROUP BY 1, 2),
r AS (SELECT series_id, sqrt(avg(uni)) AS u, sqrt(avg(bi)) AS b FROM e GROUP BY 1)
SELECT series_id, round_even(u, 6) AS rmse_uni, round_even(b, 6) AS rmse_bi, round_even(CASE WHEN u = 0 THEN 0 ELSE greatest(0, 1 - b / u) END, 6) AS gain FROM r""")
def granger_ridge_1lag(spark, sf_dir):
    """Gain of the lagged source over the target's own lag, in closed form."""
    return shown(causality.granger_gain_one_lag(price_volume(spark, sf_dir)))


@R.query("union_intersect_sets", """WITH a AS (SELECT DISTINCT symbol FROM quotes WHERE symbol IS NOT NULL), b AS (SELECT DISTINCT symbol FROM ohlcv WHERE symbol IS NOT NULL)
SELECT 'union_all' AS what, (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS n UNION ALL SELECT 'intersect', (SELECT count(*) FROM a JOIN b USING (symbol))
UNION ALL SELECT 'anti', (SELECT count(*) FROM a ANTI JOIN b USING (symbol)) UNION ALL SELECT 'semi', (SELECT count(*) FROM a SEMI JOIN b USING (symbol))""")
def union_intersect_sets(spark, sf_dir):
    """Set operations on the symbols of two tables."""
    a = table(spark, sf_dir, "quotes").where("symbol is not null").select("symbol").distinct()
    b = table(spark, sf_dir, "ohlcv").where("symbol is not null").select("symbol").distinct()
    n = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return n(a.unionByName(b), "union_all").unionByName(n(a.intersect(b), "intersect")).unionByName(n(a.join(b, "symbol", "left_anti"), "anti")).unionByName(n(a.join(b, "symbol", "left_semi"), "semi"))


@R.query("rollup_orders", """SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, count(DISTINCT o_custkey) AS customers, grouping(o_orderstatus) + grouping(o_orderpriority) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def rollup_orders(spark, sf_dir):
    """Extension: grouping sets and distinct counts."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_custkey")
    return o.rollup("status", "priority").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"), (F.grouping("status").cast("long") + F.grouping("priority").cast("long")).alias("level"))
