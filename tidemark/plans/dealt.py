"""Queries p1, p2, p4 and p5: the general data-quality operators on this project's tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.model import day_text, table
from tidemark.operators.implausible import Bounds, implausible_readings
from tidemark.operators.panel_impute import fill_panel
from tidemark.operators.regular_grid import regular_grid
from tidemark.operators.rolling_totals import rolling_totals
from tidemark.plans.base import FENCE, PANEL_NAMES


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of highest total and days whose period is empty, per symbol and period length."""
    totals = rolling_totals(table(spark, sf_dir, "ohlcv")).withColumn("rounded", F.col("total").cast("decimal(38,2)"))
    totals = totals.withColumn("top", F.max("rounded").over(W.partitionBy("entity", "win_days")))  # a series is bounded by its calendar
    return totals.withColumn("what", F.explode(F.array_compact(F.array(F.when(F.col("rounded") == F.col("top"), "peak"), F.when(F.col("n") == 0, "empty"))))).select(
        F.col("entity").alias("symbol"), "win_days", day_text(F.col("day")).alias("bar_day"), "what"
    )


def p1_rolling_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total and averages of every symbol, period and day."""
    return rolling_totals(table(spark, sf_dir, "ohlcv")).select(
        F.col("entity").alias("symbol"), "win_days", day_text(F.col("day")).alias("bar_day"), F.col("total").cast("double").alias("total"), "n",
        F.round("average", 6).alias("average"), F.round("average_reported", 6).alias("average_reported"),
    )


P1_BASE = """
WITH bars AS (
  SELECT symbol, CAST(ts AS DATE) AS d, arg_max(CAST(close AS DECIMAL(28,6)), (coalesce(ingested_at, TIMESTAMP '0001-01-01'), bar_id)) AS amount
  FROM ohlcv WHERE symbol IS NOT NULL AND close IS NOT NULL AND NOT isnan(close) GROUP BY 1, 2),
spine AS (SELECT symbol, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM bars GROUP BY symbol),
days AS (SELECT symbol, d, amount FROM spine LEFT JOIN bars USING (symbol, d)),
totals AS (
  SELECT symbol, CAST(w.win_days AS INTEGER) AS win_days, d,
    CASE WHEN w.win_days = 7 THEN coalesce(sum(amount) OVER s7, 0) ELSE coalesce(sum(amount) OVER s30, 0) END AS total,
    CASE WHEN w.win_days = 7 THEN count(amount) OVER s7 ELSE count(amount) OVER s30 END AS n
  FROM days, (VALUES (7), (30)) w(win_days)
  WINDOW s7 AS (PARTITION BY symbol, w.win_days ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         s30 AS (PARTITION BY symbol, w.win_days ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""
P1_FOUND_SQL = P1_BASE + """,
tops AS (SELECT symbol, win_days, max(CAST(total AS DECIMAL(38,2))) AS top FROM totals GROUP BY 1, 2)
SELECT symbol, win_days, strftime(d, '%Y-%m-%d') AS bar_day, 'peak' AS what FROM totals JOIN tops USING (symbol, win_days) WHERE CAST(total AS DECIMAL(38,2)) = top
UNION ALL SELECT symbol, win_days, strftime(d, '%Y-%m-%d'), 'empty' FROM totals WHERE n = 0
"""
P1_ALL_SQL = P1_BASE + """
SELECT symbol, win_days, strftime(d, '%Y-%m-%d') AS bar_day, CAST(total AS DOUBLE) AS total, n,
  round(CAST(total AS DOUBLE) / win_days, 6) AS average, round(CASE WHEN n > 0 THEN CAST(total AS DOUBLE) / n END, 6) AS average_reported FROM totals
"""


def _filled_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_panel(table(spark, sf_dir, "panel"), valid_name="^(" + "|".join(PANEL_NAMES) + ")$")


def p2_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the panel with its missing cells filled and marked."""
    return _filled_panel(spark, sf_dir).withColumnsRenamed({"row_id": "obs_id", "entity": "entity_id"})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that were filled."""
    marks = F.array(*[F.when(F.col(f"{c}_filled"), f) for c, f in (("entity", "entity_id"), ("name", "name"), ("value", "value"))])
    return _filled_panel(spark, sf_dir).select(F.col("row_id").alias("obs_id"), F.explode(F.array_compact(marks)).alias("field"))


P2_FOUND_SQL = f"""
WITH c AS (
  SELECT obs_id, load_id, column_no, regexp_replace(entity_id, '^\\s+|\\s+$', '', 'g') AS e, regexp_replace(name, '^\\s+|\\s+$', '', 'g') AS m, value AS v FROM panel),
known AS (SELECT load_id || '|' || column_no AS series_id, m, v, obs_id FROM c WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v)),
name_range AS (SELECT m, {FENCE.format("n")} FROM known WHERE m IN {PANEL_NAMES} GROUP BY 1),
codes AS (SELECT v FROM known JOIN name_range USING (m) WHERE v < na - 3 * nw OR v > nb + 3 * nw GROUP BY v HAVING count(DISTINCT series_id) >= 2 OR max(abs(v - nm) / nw) > 100)
SELECT obs_id, 'entity_id' AS field FROM c WHERE NOT coalesce(regexp_full_match(e, 'N[A-Z]{{4}}'), false)
UNION ALL SELECT obs_id, 'name' FROM c WHERE NOT coalesce(m IN {PANEL_NAMES}, false)
UNION ALL SELECT obs_id, 'value' FROM c WHERE v IS NULL OR isnan(v) OR isinf(v) OR v IN (SELECT v FROM codes)
"""


def implausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of quotes.close and series_profile.outlier_fraction with kind and score."""
    quotes = implausible_readings(table(spark, sf_dir, "quotes"), "symbol", "ts", "close", "reading_id", Bounds(0.0, True), log_scale=True)
    fractions = implausible_readings(
        table(spark, sf_dir, "series_profile"), "symbol", "profiled_at", "outlier_fraction", "profile_id", Bounds(0.0, False, 1.0),
        upper_only=True, half_window=30, spike_z=9.7, least_scale=0.002, calm_share=0.8, least_run=5,
    )
    return quotes.withColumn("tbl", F.lit("quotes")).unionByName(fractions.withColumn("tbl", F.lit("series_profile")))


def _p4_sql(name: str, source: str, ts: str, value: str, row_id: str, impossible: str, x: str, side: str, half: int, z: float, least: float, calm: float, widen: float, least_run: int) -> str:
    """Impossible, spiking and stuck rows of one table by windows over whole sources."""
    return f"""
{name}_all AS (SELECT {source} AS s, epoch_us({ts}) AS t, {value} + 0.0 AS v, {row_id} AS id FROM {name} WHERE {value} IS NOT NULL AND NOT isnan({value})),
{name}_one AS (SELECT *, {x} AS x, row_number() OVER (PARTITION BY s ORDER BY t, v) AS i, count(*) OVER (PARTITION BY s) AS n
  FROM (SELECT DISTINCT s, t, v FROM {name}_all WHERE NOT ({impossible}) AND s IS NOT NULL AND t IS NOT NULL)),
{name}_dev AS (SELECT *, x - median(x) OVER (PARTITION BY s ORDER BY i ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS d, abs(x - lag(x) OVER (PARTITION BY s ORDER BY i)) AS step, lag(v) OVER (PARTITION BY s ORDER BY i) AS pv FROM {name}_one),
{name}_bin AS (SELECT s, CASE WHEN d = 0 THEN 0 ELSE 2 ** ((floor(log2(abs(d)) * 1024) + 0.5) / 1024) END AS size, count(*) AS c FROM {name}_dev GROUP BY 1, 2),
{name}_cum AS (SELECT *, sum(c) OVER (PARTITION BY s ORDER BY size) AS upto, sum(c) OVER (PARTITION BY s) AS n FROM {name}_bin),
{name}_mad AS (SELECT s, 1.4826 * min(size) FILTER (WHERE 2 * upto >= n) AS mad, {widen!r} * sum(c * size) FILTER (WHERE upto - c < {calm} * n) / sum(c) FILTER (WHERE upto - c < {calm} * n) AS calm FROM {name}_cum GROUP BY 1),
{name}_scale AS (SELECT s, greatest({least}, coalesce(0.3 * (SELECT min(step) FROM {name}_dev e WHERE e.s = m.s AND step > 0), 0), CASE WHEN mad > 0 THEN mad ELSE calm END) AS scale FROM {name}_mad m),
{name}_run AS (SELECT *, sum(CASE WHEN v IS DISTINCT FROM pv THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY i) AS run FROM {name}_dev),
{name}_runs AS (SELECT s, run, any_value(v) AS v, min(i) AS first, count(*) AS len, any_value(n) AS n FROM {name}_run GROUP BY 1, 2),
{name}_vals AS (SELECT s, v, any_value(n) AS n, sum(len) AS often, count(*) AS r1, count(*) FILTER (WHERE len >= 2) AS r2, count(*) FILTER (WHERE len >= 3) AS r3 FROM {name}_runs GROUP BY 1, 2),
{name}_sums AS (SELECT s, coalesce(sum(r1) FILTER (WHERE often <= 0.3 * n), 0) AS r1, coalesce(sum(r2) FILTER (WHERE often <= 0.3 * n), 0) AS r2, coalesce(sum(r3) FILTER (WHERE often <= 0.3 * n), 0) AS r3 FROM {name}_vals GROUP BY 1),
{name}_rate AS (SELECT s, greatest(0.01, r2 / greatest(1, r1), (r3 + 10 * r2 / greatest(1, r1)) / (r2 + 10)) AS p FROM {name}_sums),
{name}_long AS (SELECT r.s, run, first, len, r.n, least(0.98, greatest(p, (often - len) / greatest(1, r.n - len))) AS p FROM {name}_runs r JOIN {name}_rate USING (s) JOIN {name}_vals w ON w.s = r.s AND w.v = r.v WHERE len >= {least_run}),
{name}_stuck AS (SELECT * FROM {name}_long WHERE len >= 2.3 * ln(greatest(2.0, n * (1 - p))) / ln(1 / p) AND len <= 0.9 * n),
{name}_flags AS (
  SELECT s, t, v FROM {name}_dev JOIN {name}_scale USING (s) WHERE {side} > {z} * scale AND {side} > 0
  UNION SELECT r.s, r.t, r.v FROM {name}_run r JOIN {name}_stuck k ON k.s = r.s AND k.run = r.run WHERE r.i > k.first),
{name}_found AS (SELECT id FROM {name}_all WHERE {impossible} UNION SELECT id FROM {name}_all JOIN {name}_flags USING (s, t, v))"""


#: Mean absolute deviation to deviation, and the factor for a mean over the calmest 80 % of normal deviations.
P4_FOUND_SQL = (
    "WITH"
    + _p4_sql("quotes", "symbol", "ts", "close", "reading_id", "v <= 0 OR isinf(v)", "ln(v)", "abs(d)", 7, 12.5, 0.0, 0.98, 1.2533, 6)
    + ","
    + _p4_sql("series_profile", "symbol", "profiled_at", "outlier_fraction", "profile_id", "v < 0 OR v > 1 OR isinf(v)", "v", "d", 30, 9.7, 0.002, 0.8, 1.2533 * 0.8 / (1 - math.exp(-(1.2815515655446004**2) / 2)), 5)
    + " SELECT 'quotes' AS tbl, id AS row_id FROM quotes_found UNION ALL SELECT 'series_profile', id FROM series_profile_found"
)


def p4_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flag with its reason."""
    return implausible(spark, sf_dir).select("tbl", "row_id", F.col("source").alias("symbol"), "kind", F.round("score", 3).alias("score"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implausible rows of quotes and series_profile, each once."""
    return implausible(spark, sf_dir).select("tbl", "row_id").distinct()


def p5_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regular series of every window."""
    return regular_grid(table(spark, sf_dir, "quotes"), table(spark, sf_dir, "feed_windows")).select(
        F.col("window").alias("window_id"), F.col("entity").alias("symbol"), "slot_epoch", "n_readings", F.bround("average", 6).alias("average"), F.bround("coverage", 6).alias("coverage"), F.col("held").alias("held_close"), "status",
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots without a usable reading."""
    grid = regular_grid(table(spark, sf_dir, "quotes"), table(spark, sf_dir, "feed_windows"))
    return grid.where("n_readings = 0").select(F.col("entity").alias("symbol"), "slot_epoch")


P5_BASE = """
WITH w AS (SELECT window_id, symbol, epoch_us(start_ts) AS s, epoch_us(end_ts) AS e, grid_seconds::BIGINT * 1000000 AS g FROM feed_windows
           WHERE symbol IS NOT NULL AND start_ts < end_ts AND grid_seconds > 0),
slots AS (SELECT window_id, symbol, s, e, g, unnest(generate_series(0, ((e - s + g - 1) // g) - 1)) AS i FROM w),
q AS (SELECT window_id, symbol, s, e, g, epoch_us(ts) AS t, (epoch_us(ts) - s) // g AS i, close, arrived_at, reading_id FROM quotes JOIN w USING (symbol)
      WHERE epoch_us(ts) >= s AND epoch_us(ts) < e AND close IS NOT NULL AND NOT isnan(close))
"""
P5_FOUND_SQL = P5_BASE + """
SELECT symbol, (s + i * g) // 1000000 AS slot_epoch FROM slots ANTI JOIN (SELECT DISTINCT window_id, i FROM q) USING (window_id, i)
"""
P5_GRID_SQL = P5_BASE + """,
per_slot AS (SELECT window_id, i, count(*) AS n, arg_max(close, (t, coalesce(arrived_at, TIMESTAMP '0001-01-01'), reading_id)) AS last_close FROM q GROUP BY 1, 2),
first_t AS (SELECT window_id, min(t) AS t0 FROM q GROUP BY 1),
filled AS (
  SELECT window_id, symbol, s, e, g, i, coalesce(n, 0) AS n_readings, last_value(last_close IGNORE NULLS) OVER (PARTITION BY window_id ORDER BY i) AS held
  FROM slots LEFT JOIN per_slot USING (window_id, i)),
steps AS (SELECT window_id, s, g, t, close AS v, lead(t, 1, e) OVER (PARTITION BY window_id ORDER BY t, coalesce(arrived_at, TIMESTAMP '0001-01-01'), reading_id) AS stop FROM q),
parts AS (SELECT *, unnest(generate_series((t - s) // g, (greatest(stop - 1, t) - s) // g)) AS i FROM steps),
held_us AS (SELECT window_id, i, v, greatest(0, least(stop, s + (i + 1) * g) - greatest(t, s + i * g)) AS us FROM parts),
means AS (SELECT window_id, i, sum(v * us) FILTER (WHERE us > 0) / nullif(sum(us), 0) AS average FROM held_us GROUP BY 1, 2)
SELECT window_id, symbol, (s + i * g) // 1000000 AS slot_epoch, n_readings,
  round_even(greatest(0, least(e, s + (i + 1) * g) - greatest(s + i * g, coalesce(t0, e)))::DOUBLE / (least(e, s + (i + 1) * g) - (s + i * g)), 6) AS coverage,
  round_even(average, 6) AS average, held AS held_close, CASE WHEN n_readings > 0 THEN 'observed' WHEN held IS NOT NULL THEN 'filled' ELSE 'missing' END AS status
FROM filled LEFT JOIN first_t USING (window_id) LEFT JOIN means USING (window_id, i)
"""

QUERIES = {"p1_found": p1_found, "p1_rolling_totals": p1_rolling_totals, "p2_found": p2_found, "p2_filled": p2_filled, "p4_found": p4_found, "p4_flags": p4_flags, "p5_found": p5_found, "p5_grid": p5_grid}
ORACLES = {"p1_found": P1_FOUND_SQL, "p1_rolling_totals": P1_ALL_SQL, "p2_found": P2_FOUND_SQL, "p4_found": P4_FOUND_SQL, "p5_found": P5_FOUND_SQL, "p5_grid": P5_GRID_SQL}
