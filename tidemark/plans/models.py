"""Queries on estimators, diagnostics, pipelines, reports, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.series import by_series, log_return, quarter_end
from tidemark.model import table
from tidemark.operators import align, backtest, causality, diagnostics, estimators, ordered, pipeline, regimes as regime_ops, report
from tidemark.plans.analysis import ORIGINS, START, END, price_volume
from tidemark.plans.base import CLOSES, NUDGE, PANEL, PANEL_NAMES, REGIMES, Registry, closes, panel_series, regimes, shown
from tidemark.session import cut_lineage
from tidemark.sources import catalog
from tidemark.streaming import windows

R = Registry()
W_ = "WINDOW w AS (PARTITION BY series_id ORDER BY ts)"


def log_returns(spark, sf_dir):
    return closes(spark, sf_dir).withColumn("value", log_return()).where("value is not null")


@R.query("adf_test")
def adf_test(spark, sf_dir):
    """M1: unit-root test of every close series."""
    return shown(estimators.dickey_fuller(closes(spark, sf_dir)))


@R.query("min_d_search")
def min_d_search(spark, sf_dir):
    """M2: least order of differencing."""
    return shown(estimators.least_order(closes(spark, sf_dir)))


@R.query("stl_decompose")
def stl_decompose(spark, sf_dir):
    """M3: trend, seasonal, rest."""
    return shown(estimators.seasonal_trend(closes(spark, sf_dir), 7))


@R.query("sarima_grid")
def sarima_grid(spark, sf_dir):
    """Best seasonal order by AIC."""
    return shown(estimators.seasonal_arma(closes(spark, sf_dir), 7), 3)


@R.query("two_stage_filter")
def two_stage_filter(spark, sf_dir):
    """M5, M6: filtered series with its metrics and the entropies before and after."""
    parts = cut_lineage(estimators.two_stage_filter(closes(spark, sf_dir), 7))
    return shown(ordered.filter_metrics(parts).join(ordered.filter_entropies(parts), "series_id"))


H, Q = 1.0, 0.1


@R.query("kalman_local_level_fixed", f"""WITH RECURSIVE {CLOSES}, s AS (SELECT series_id, value AS y, row_number() OVER w AS i FROM closes {W_}),
k(series_id, i, a, p, l) AS (SELECT series_id, i, y, {H}::DOUBLE, 0.0::DOUBLE FROM s WHERE i = 1
  UNION ALL SELECT k.series_id, s.i, k.a + (k.p + {Q}) / (k.p + {Q} + {H}) * (s.y - k.a), (k.p + {Q}) * (1 - (k.p + {Q}) / (k.p + {Q} + {H})), k.l - 0.5 * (ln(2 * pi() * (k.p + {Q} + {H})) + (s.y - k.a) ** 2 / (k.p + {Q} + {H})) FROM k JOIN s ON s.series_id = k.series_id AND s.i = k.i + 1)
SELECT series_id, i AS n, round_even(a, 5) AS level, round_even(p, 5) AS variance, round_even(l, 3) AS loglik FROM k WHERE (series_id, i) IN (SELECT series_id, max(i) FROM s GROUP BY 1)""")
def kalman_local_level_fixed(spark, sf_dir):
    """M8: local level filter with given variances, as a fold."""
    k = estimators.fixed_local_level(closes(spark, sf_dir), H, Q)
    rounded = lambda c, d: F.bround(F.col(c) + NUDGE, d).alias(c)
    return k.select("series_id", "n", rounded("level", 5), rounded("variance", 5), rounded("loglik", 3))


LOGS = f"lr AS (SELECT * FROM (SELECT series_id, ts, CASE WHEN value > 0 AND lag(value) OVER w > 0 THEN ln(value / lag(value) OVER w) END AS x FROM closes {W_}) WHERE x IS NOT NULL)"


@R.query("viterbi_fixed", f"""WITH RECURSIVE {CLOSES}, {LOGS}, s AS (SELECT series_id, row_number() OVER w AS i, -0.5 * ln(2 * pi()) - ln(0.01) - 0.5 * ((x - 0.0005) / 0.01) ** 2 AS b0, -0.5 * ln(2 * pi()) - ln(0.03) - 0.5 * ((x + 0.001) / 0.03) ** 2 AS b1 FROM lr {W_}),
v(series_id, i, s0, s1) AS (SELECT series_id, i, ln(0.5) + b0, ln(0.5) + b1 FROM s WHERE i = 1
  UNION ALL SELECT v.series_id, s.i, greatest(s0 + ln(0.95), s1 + ln(0.05)) + b0, greatest(s1 + ln(0.95), s0 + ln(0.05)) + b1 FROM v JOIN s ON s.series_id = v.series_id AND s.i = v.i + 1)
SELECT series_id, i AS n, CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS state, round_even(greatest(s0, s1), 4) AS score FROM v WHERE (series_id, i) IN (SELECT series_id, max(i) FROM s GROUP BY 1)""")
def viterbi_fixed(spark, sf_dir):
    """Best path of a given two-state model, as a fold."""
    return shown(estimators.fixed_viterbi(log_returns(spark, sf_dir)), 4)


@R.query("kalman_mle")
def kalman_mle(spark, sf_dir):
    """M8, M9: fitted variances, likelihood and AIC."""
    return estimators.kalman_summary(closes(spark, sf_dir))


@R.query("kalman_components")
def kalman_components(spark, sf_dir):
    """M9: smoothed level and trend, residuals, in long form."""
    return shown(estimators.kalman(closes(spark, sf_dir), "smooth trend"))


@R.query("kalman_forecast")
def kalman_forecast(spark, sf_dir):
    """M9, O3: seven days ahead with bounds."""
    return shown(estimators.kalman_forecast(closes(spark, sf_dir), 7))


@R.query("kalman_vs_arima")
def kalman_vs_arima(spark, sf_dir):
    """Which of the two forecasts the last rows better."""
    return shown(estimators.kalman_against_arima(closes(spark, sf_dir)))


@R.query("hmm_regimes")
def hmm_regimes(spark, sf_dir):
    """Hidden states of the returns."""
    return shown(estimators.hidden_regimes(log_returns(spark, sf_dir)).drop("p", "move"))


@R.query("hmm_state_scores")
def hmm_state_scores(spark, sf_dir):
    """Held-out score of each number of states."""
    return shown(estimators.state_scores(log_returns(spark, sf_dir)))


def _regime_now(spark, sf_dir):
    hidden = estimators.hidden_regimes(log_returns(spark, sf_dir))
    stats = regime_ops.regime_statistics(hidden.withColumnRenamed("state", "label")).withColumnRenamed("label", "state")
    return estimators.current_regime(hidden, regime_ops.name_states(stats))


@R.query("current_regime")
def current_regime(spark, sf_dir):
    """Regime, confidence, risk of leaving it, days in it."""
    return shown(_regime_now(spark, sf_dir))


def _panel_features(spark, sf_dir):
    s = panel_series(spark, sf_dir)
    f = align.mixed_frequency_features(s).where("value is not null")
    return f.select(F.split("series_id", "\\|")[0].alias("entity"), "quarter", F.concat_ws("_", F.split("series_id", "\\|")[1], "feature").alias("name"), "value")


NAMES = [f"{n}_{s}" for n in ("jobless_claims", "credit_spread") for s in ("mean", "std", "min", "max", "last")] + [f"{n}_m{k}" for n in ("PMI", "cpi_yoy", "retail_turnover") for k in (1, 2, 3)]
TARGET = "GDP_growth_value"


@R.query("mice_panel")
def mice_panel(spark, sf_dir):
    """M7: chained imputation of each entity's quarterly matrix."""
    return shown(estimators.chained_imputation(_panel_features(spark, sf_dir), "entity", "quarter", "name", "value", [*NAMES, TARGET]))


@R.query("mean_impute", f"""WITH {PANEL}, wide AS (SELECT split_part(series_id, '|', 1) AS entity, ts, name, avg(value) AS v FROM panel_series GROUP BY 1, 2, 3), m AS (SELECT name, avg(v) AS mean FROM wide GROUP BY 1)
SELECT entity, CAST(ts AS VARCHAR) AS ts, name, round_even(coalesce(v, mean), 5) AS filled FROM (SELECT DISTINCT entity, ts FROM wide) CROSS JOIN m LEFT JOIN wide USING (entity, ts, name)""")
def mean_impute(spark, sf_dir):
    """M7: the mean as first guess of every column, by the library's imputer."""
    from pyspark.ml.feature import Imputer

    s = panel_series(spark, sf_dir).withColumn("entity", F.split("series_id", "\\|")[0])
    wide = s.groupBy("entity", "ts").pivot("name", list(PANEL_NAMES)).agg(F.avg("value"))
    filled = Imputer(inputCols=list(PANEL_NAMES), outputCols=[f"{n}_filled" for n in PANEL_NAMES], strategy="mean").fit(wide).transform(wide)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}_filled").alias("filled")) for n in PANEL_NAMES]))
    return shown(filled.select("entity", "ts", each.alias("x")).select("entity", "ts", "x.name", "x.filled"), 5)


@R.query("gbt_panel")
def gbt_panel(spark, sf_dir):
    """Boosted trees over all entities, with the entity as a category; fitted and predicted per quarter."""
    from tidemark.operators.forecaster import fit_panel

    predictions, _ = fit_panel(_panel_features(spark, sf_dir), NAMES, TARGET)
    return shown(predictions)


@R.query("gbt_importances")
def gbt_importances(spark, sf_dir):
    """Feature importances of the same model."""
    from tidemark.operators.forecaster import fit_panel

    _, importances = fit_panel(_panel_features(spark, sf_dir), NAMES, TARGET)
    return shown(importances)


@R.query("granger_linear")
def granger_linear(spark, sf_dir):
    """Gain of three source lags, ridge."""
    return shown(estimators.granger(price_volume(spark, sf_dir)))


@R.query("granger_neighbours")
def granger_neighbours(spark, sf_dir):
    """The same with nearest neighbours."""
    return shown(estimators.granger(price_volume(spark, sf_dir), kind="knn"))


@R.query("causality_classes")
def causality_classes(spark, sf_dir):
    """Cross map with surrogates and Granger gain over four horizons, and the class they give."""
    return causality.causal_class(estimators.full_causality(price_volume(spark, sf_dir)))


@R.query("pairwise_drivers")
def pairwise_drivers(spark, sf_dir):
    """Which series help to forecast the named asset."""
    from tidemark.operators.assets import daily_returns

    return shown(estimators.drivers(daily_returns(closes(spark, sf_dir)), ["QORVEX-USD"], -1.0))


@R.query("regimes_of_new_rows")
def regimes_of_new_rows(spark, sf_dir):
    """Posteriors of each series' last 60 days under a model of the days before."""
    r = log_returns(spark, sf_dir)
    cut = r.groupBy("series_id").agg(F.date_sub(F.max("ts"), 60).alias("cut"))
    parts = r.join(cut, "series_id")
    new = estimators.regimes_of_new(parts.where("ts <= cut"), parts.where("ts > cut"))
    return shown(new.select("series_id", "ts", F.element_at("p", -1).alias("wildest")))


@R.query("ffd_weights_sql", """WITH RECURSIVE w(k, v) AS (SELECT 0, 1.0::DOUBLE UNION ALL SELECT k + 1, -v * (0.4::DOUBLE - k) / (k + 1) FROM w WHERE abs(v * (0.4::DOUBLE - k) / (k + 1)) >= 0.01)
SELECT CAST((SELECT max(k) FROM w) - k AS INTEGER) AS place, round_even(v, 6) AS weight FROM w""")
def ffd_weights_sql(spark, sf_dir):
    """W1 as a table function in SQL text."""
    from tidemark.functions.registered import register_functions

    register_functions(spark)
    return shown(spark.sql("select place, weight from ffd_weights(0.4D, 0.01D)"))


def _forecasts(spark, sf_dir):
    w = by_series()
    past = w.rowsBetween(-3, -1)
    c = closes(spark, sf_dir)
    return c.select("series_id", "ts", F.col("value").alias("actual"), F.avg("value").over(past).alias("mean3"), (F.lag("value", 1).over(w) * 1.01).alias("drift"))


@R.query("baseline_check", f"""WITH {CLOSES}, f AS (SELECT series_id, value AS actual, avg(value) OVER p AS mean3, lag(value, 1) OVER w * 1.01 AS drift, lag(value, 1) OVER w AS naive, lag(value, 4) OVER w AS snaive FROM closes WINDOW w AS (PARTITION BY series_id ORDER BY ts), p AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
l AS (SELECT series_id, 'mean3' AS model, actual, mean3 AS predicted, naive, snaive FROM f UNION ALL SELECT series_id, 'drift', actual, drift, naive, snaive FROM f),
m AS (SELECT series_id, model, count(actual - predicted) AS n, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) ** 2)) AS rmse, avg(abs(actual - naive)) AS mae_naive, avg(abs(actual - snaive)) AS mae_snaive FROM l GROUP BY 1, 2)
SELECT series_id, model, n, round_even(mae, 5) AS mae, round_even(rmse, 5) AS rmse, round_even(mae_naive, 5) AS mae_naive, round_even(mae_snaive, 5) AS mae_snaive, coalesce(mae < mae_naive AND mae < mae_snaive, false) AS baseline FROM m""")
def baseline_check(spark, sf_dir):
    """M17.1: models against the naive forecasts."""
    return shown(diagnostics.baseline_check(diagnostics.residual_rows(_forecasts(spark, sf_dir), ["mean3", "drift"])), 5)


@R.query("horizon_filter", f"""WITH {CLOSES}, f AS (SELECT series_id, value AS actual, lag(value, 2) OVER w AS predicted FROM closes {W_})
SELECT series_id, CAST(2 AS INTEGER) AS horizon_step, count(predicted) AS n, round_even(avg(abs(actual - predicted)), 5) AS mae FROM f GROUP BY 1""")
def horizon_filter(spark, sf_dir):
    """Forecasts of four horizons, of which one is looked at."""
    w = by_series()
    lagged = closes(spark, sf_dir).select("series_id", "ts", F.col("value").alias("actual"), *[F.lag("value", k).over(w).alias(f"p{k}") for k in range(1, 5)])
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("horizon_step"), F.col(f"p{k}").alias("predicted")) for k in range(1, 5)]))
    frame = lagged.select("series_id", "ts", "actual", steps.alias("f")).select("series_id", "ts", "actual", "f.*")
    at = diagnostics.at_horizon(frame, 2)
    return shown(at.groupBy("series_id", "horizon_step").agg(F.count("predicted").alias("n"), F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae")), 5)


@R.query("forensic_report")
def forensic_report(spark, sf_dir):
    """All tests of every model."""
    return shown(diagnostics.forensic_report(_forecasts(spark, sf_dir), ["mean3", "drift"]))


@R.query("feature_leakage")
def feature_leakage(spark, sf_dir):
    """M17.7: does a forest find the residual in the features?"""
    rows = diagnostics.residual_rows(_forecasts(spark, sf_dir), ["mean3"]).withColumn("dow", F.dayofweek("ts").cast("double")).withColumn("month", F.month("ts").cast("double"))
    return shown(diagnostics.feature_leakage(rows, "residual", ["dow", "month"]), 5)


@R.query("pipeline_check")
def pipeline_check(spark, sf_dir):
    """Four checks of the filter's residuals."""
    r = estimators.kalman(closes(spark, sf_dir), "local level").where("component = 'residual'")
    return diagnostics.pipeline_check(r.select("series_id", "ts", "value"))


@R.query("characteristics")
def characteristics(spark, sf_dir):
    """O1: what the choice of a pipeline looks at."""
    return shown(pipeline.characteristics(closes(spark, sf_dir)))


def _chosen(spark, sf_dir):
    return pipeline.choose(pipeline.characteristics(closes(spark, sf_dir)).join(_regime_now(spark, sf_dir), "series_id", "left").withColumn("regime", F.coalesce("regime", F.lit("unknown"))))


@R.query("autopilot_select")
def autopilot_select(spark, sf_dir):
    """The pipeline of every series, with its reason."""
    return shown(_chosen(spark, sf_dir).select("series_id", "regime", "pipeline", "reason"))


@R.query("pipeline_forecast")
def pipeline_forecast(spark, sf_dir):
    """Every series forecast by its own pipeline."""
    return shown(pipeline.forecast_chosen(closes(spark, sf_dir), _chosen(spark, sf_dir)))


@R.query("walk_forward_models")
def walk_forward_models(spark, sf_dir):
    """Walk-forward with regime, choice and fit at every origin."""
    return shown(backtest.error_metrics(pipeline.walk_forward(closes(spark, sf_dir), step=7), ["series_id"]), 4)


@R.query("pipeline_advantage")
def pipeline_advantage(spark, sf_dir):
    """Error of the chosen pipelines against always taking the conservative one, refitted at the same origins."""
    w = pipeline.walk_forward(closes(spark, sf_dir), step=14, against="conservative")
    error = lambda c: F.avg(F.abs(F.col(c) - F.col("actual")))
    m = w.groupBy("series_id").agg(error("forecast").alias("mae"), error("against").alias("conservative_mae"))
    return shown(m.withColumn("advantage", F.when(F.col("conservative_mae") > 0, F.expr("100 * try_divide(conservative_mae - mae, conservative_mae)")).otherwise(0.0)), 4)


@R.query("analyze_report")
def analyze_report(spark, sf_dir):
    """The whole analysis of every series, as Markdown, with the four checks of its residuals and what its volume is to it."""
    chosen = _chosen(spark, sf_dir)
    last = pipeline.forecast_chosen(closes(spark, sf_dir), chosen).where("step = 7").select("series_id", "price", "forecast", "lower", "upper")
    residuals = estimators.kalman(closes(spark, sf_dir), "local level").where("component = 'residual'").select("series_id", "ts", "value")
    checks = diagnostics.pipeline_check(residuals)
    ok = sum((F.col(c).cast("int") for c in ("centred", "noise", "normal", "finite")), F.lit(0))
    facts = chosen.join(last, "series_id").join(checks.select("series_id", ok.alias("passed"), F.lit(4).alias("tests")), "series_id", "left")
    cause = causality.causal_class(estimators.full_causality(price_volume(spark, sf_dir))).select("series_id", F.col("class").alias("volume_is"))
    return report.markdown(report.with_report(facts)).join(cause, "series_id", "left")


LAST = f"""WITH {ORIGINS}, {REGIMES}, lastl AS (SELECT series_id, arg_max(label, ts) AS regime FROM labels GROUP BY 1), lo AS (SELECT series_id, max(origin) AS origin FROM fc GROUP BY 1),
rfacts AS (SELECT fc.series_id, coalesce(regime, 'unknown') AS regime, price, forecast, lower, upper, CASE WHEN forecast >= lower THEN 2 ELSE 1 END AS passed, 3 AS tests FROM fc JOIN lo USING (series_id, origin) LEFT JOIN lastl USING (series_id))"""


def _report_facts(spark, sf_dir):
    fc = backtest.naive_forecasts(backtest.origins_and_actuals(closes(spark, sf_dir), START, END))
    last = fc.groupBy("series_id").agg(F.max_by(F.struct("price", "forecast", "lower", "upper"), "origin").alias("f")).select("series_id", "f.*")
    label = regimes(spark, sf_dir).groupBy("series_id").agg(F.max_by("label", "ts").alias("regime"))
    facts = last.join(label, "series_id", "left").withColumn("regime", F.coalesce("regime", F.lit("unknown")))
    return facts.withColumn("passed", F.when(F.col("forecast") >= F.col("lower"), 2).otherwise(1)).withColumn("tests", F.lit(3)).withColumn("confidence", F.lit(None).cast("double")).withColumn("transition_risk", F.lit(None).cast("double"))


@R.query("report_facts", LAST + """ SELECT series_id, regime, round_even(passed / tests, 6) AS quality, CASE WHEN passed / tests >= 0.8 THEN 'HIGH' WHEN passed / tests >= 0.6 THEN 'MEDIUM' WHEN passed / tests >= 0.4 THEN 'LOW' ELSE 'UNRELIABLE' END AS quality_label,
array_to_string([x FOR x IN [CASE WHEN regime IN ('crisis', 'bear') THEN 'In a ' || regime || ' regime forecasts are less certain' END, CASE WHEN tests > passed THEN (tests - passed) || ' of ' || tests || ' tests failed' END, CASE WHEN (upper - lower) / abs(forecast) > 0.2 THEN 'Wide band around the forecast' END] IF x IS NOT NULL], '; ') AS warnings,
CASE regime WHEN 'bear' THEN 'Smaller positions suit a falling market' WHEN 'crisis' THEN 'Defensive positions suit a crisis; Watch volatility for a return to calm' WHEN 'bull' THEN 'Following the trend may pay' WHEN 'sideways' THEN 'Reverting to the mean may pay' ELSE '' END AS advice FROM rfacts""")
def report_facts(spark, sf_dir):
    """Quality, warnings and advice."""
    r = report.with_report(_report_facts(spark, sf_dir))
    return shown(r.select("series_id", "regime", "quality", "quality_label", F.array_join("warnings", "; ").alias("warnings"), F.array_join("advice", "; ").alias("advice")))


@R.query("report_markdown")
def report_markdown(spark, sf_dir):
    """Markdown with summary."""
    return report.markdown(report.with_report(_report_facts(spark, sf_dir)))


@R.query("report_json", LAST + " SELECT series_id, regime, tests FROM rfacts")
def report_json(spark, sf_dir):
    """JSON, read again."""
    j = report.as_json(report.with_report(_report_facts(spark, sf_dir)))
    return j.select("series_id", F.get_json_object("json", "$.regime").alias("regime"), F.get_json_object("json", "$.tests").cast("int").alias("tests"))


@R.query("backtest_summary_text", f"""WITH {ORIGINS}, m AS (SELECT series_id, count(*) AS n, avg(abs(forecast - actual)) AS mae FROM fc GROUP BY 1) SELECT series_id, CAST(n AS VARCHAR) || ' periods' AS head FROM m""")
def backtest_summary_text(spark, sf_dir):
    """One line of text per series; its first words are compared."""
    fc = backtest.naive_forecasts(backtest.origins_and_actuals(closes(spark, sf_dir), START, END))
    return report.backtest_text(backtest.error_metrics(fc, ["series_id"])).select("series_id", F.split("text", ",")[0].alias("head"))


CODES = {"PMI": "GDPC1", "cpi_yoy": "CPIAUCSL", "jobless_claims": "ICSA", "credit_spread": "BAMLC0A0CM", "retail_turnover": "DGS10", "GDP_growth": "DGS2"}
CODES_SQL = "(VALUES " + ", ".join(f"('{n}', '{c}')" for n, c in CODES.items()) + ") k(name, code)"


def _landed(spark, sf_dir):
    codes = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    return panel_series(spark, sf_dir).select(codes[F.col("name")].alias("code"), "ts", "value").groupBy("code", "ts").agg(F.max("value").alias("value"))


@R.query("bundle_macro_us", f"WITH {PANEL}, l AS (SELECT code, ts, max(value) AS value FROM panel_series JOIN {CODES_SQL} USING (name) GROUP BY 1, 2) SELECT grp, n.name, CAST(ts AS VARCHAR) AS ts, value FROM l JOIN (VALUES ('gdp','real','GDPC1'), ('inflation','CPI','CPIAUCSL'), ('employment','Initial_Claims','ICSA')) n(grp, name, code) USING (code) WHERE ts >= DATE '2012-01-01'")
def bundle_macro_us(spark, sf_dir):
    """A bundle out of landed observations, from a start date on."""
    return shown(catalog.load_bundle(_landed(spark, sf_dir), "macro_us", "2012-01-01"))


@R.query("yield_curve_slope", f"WITH {PANEL}, l AS (SELECT code, ts, max(value) AS value FROM panel_series JOIN {CODES_SQL} USING (name) GROUP BY 1, 2) SELECT CAST(a.ts AS VARCHAR) AS ts, round_even(a.value - b.value, 6) AS slope FROM l a JOIN l b USING (ts) WHERE a.code = 'DGS10' AND b.code = 'DGS2'")
def yield_curve_slope(spark, sf_dir):
    """Slope out of two series where the ready one is missing."""
    return shown(catalog.slope(_landed(spark, sf_dir)))


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@R.query("stream_tumbling", "SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS start, event_type, count(*) AS n, round_even(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    """Extension: tumbling windows over the event stream, run to its end."""
    s = windows.tumbling(windows.read_stream(spark, sf_dir, "events.parquet", EVENTS), "event_type", "value")
    return shown(windows.run_to_end(s, "stream_tumbling_out", "complete").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total"), 4)


@R.query("stream_local_level")
def stream_local_level(spark, sf_dir):
    """Extension: a stateful filter per event type."""
    s = windows.local_level(windows.read_stream(spark, sf_dir, "events.parquet", EVENTS), "event_type", "value")
    return shown(windows.run_to_end(s, "stream_local_level_out", "update"))


@R.query("sessions_by_user", """WITH e AS (SELECT user_id, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) >= 1800000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions_by_user(spark, sf_dir):
    """Extension: session windows, in batch."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.sessions(e, "user_id").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
