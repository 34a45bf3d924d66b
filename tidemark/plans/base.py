"""Registry helpers and the series the reference queries run on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.spelling import keys_of
from tidemark.model import finite, table, usable
from tidemark.operators.panel_impute import without_fill_codes

Query = Callable[[SparkSession, str], DataFrame]


#: Added before rounding on both sides: it moves exact ties, where the engines round differently, off the boundary.
NUDGE = 3.1e-9


def spelled_out(sql: str) -> str:
    """count_if(x) as a BIGINT count, and round_even(x, d) with the nudge."""
    for name, write in (("count_if", lambda body: f"count(*) FILTER (WHERE {body})"), ("round_even", lambda body: _nudged(body))):
        out, at = [], 0
        while (start := sql.find(name + "(", at)) >= 0:
            depth, end = 0, start + len(name)
            for end in range(start + len(name), len(sql)):
                depth += (sql[end] == "(") - (sql[end] == ")")
                if depth == 0:
                    break
            out += [sql[at:start], write(sql[start + len(name) + 1 : end])]
            at = end + 1
        sql = "".join(out) + sql[at:]
    return sql


def _nudged(body: str) -> str:
    value, _, digits = body.rpartition(",")
    return f"round_even(({value}) + {NUDGE}, {digits.strip()})"


class Registry:
    """Queries by name, with the SQL of those SQL can express."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(function: Query) -> Query:
            self.queries[name] = function
            if sql is not None:
                self.oracles[name] = spelled_out(sql)
            return function

        return put


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Dates as text and doubles rounded half even, as results are compared."""
    columns = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "date":
            c = c.cast("string")
        elif kind == "double":
            c = F.bround(c + NUDGE, digits)
        columns.append(c.alias(name))
    return df.select(*columns)


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, ts (date), value: each symbol's last reported usable close of a day."""
    bars = table(spark, sf_dir, "ohlcv").select("symbol", F.col("ts").cast("date").alias("day"), usable("close").alias("v"), "ingested_at", "bar_id").where("symbol is not null and day is not null and v is not null")
    return bars.groupBy(F.col("symbol").alias("series_id"), F.col("day").alias("ts")).agg(F.max_by("v", F.struct("ingested_at", "bar_id")).alias("value"))


CLOSES = """closes AS (
  SELECT symbol AS series_id, CAST(ts AS DATE) AS ts, arg_max(close, (coalesce(ingested_at, TIMESTAMP '0001-01-01'), bar_id)) AS value
  FROM ohlcv WHERE symbol IS NOT NULL AND ts IS NOT NULL AND close IS NOT NULL AND NOT isnan(close) GROUP BY 1, 2)"""


def order_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, ts, value: mean order price of each day, per order priority."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("ts")).agg((F.sum(F.col("o_totalprice").cast("decimal(28,2)")) / F.count("o_totalprice")).cast("double").alias("value"))


# The panel's real names; the regimes' labels, and words that say nothing about which regime it is.
PANEL_NAMES = ("GDP_growth", "PMI", "jobless_claims", "cpi_yoy", "retail_turnover", "credit_spread")
LABELS = ("bull", "bear", "crisis", "sideways", "unknown")
LABEL_FILLERS = ("market", "regime")


def panel_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, name, freq, ts, value: the panel's rows with real content, the last received of a day."""
    rows = table(spark, sf_dir, "panel").select("entity_id", "name", "freq", F.col("obs_date").alias("ts"), finite("value").alias("raw"), "received_at", "obs_id")
    rows = rows.where(F.col("entity_id").rlike("^N[A-Z]{4}$") & F.col("name").isin(*PANEL_NAMES) & F.expr("ts is not null and raw is not null"))
    rows = without_fill_codes(rows.withColumn("series", F.concat_ws("|", "entity_id", "name"))).where("v is not null")
    return rows.groupBy(F.col("series").alias("series_id"), "name", "freq", "ts").agg(F.max_by("v", F.struct("received_at", "obs_id")).alias("value"))


#: Fences of a group of numbers, as in panel_impute: quartiles, and their distance but at least a hundredth of the median.
FENCE = "quantile_cont(v, 0.25) AS {0}a, quantile_cont(v, 0.75) AS {0}b, quantile_cont(v, 0.5) AS {0}m, greatest(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), abs(quantile_cont(v, 0.5)) / 100) AS {0}w"
PANEL = f"""cells AS (
  SELECT entity_id || '|' || name AS series_id, name, freq, obs_date AS ts, value AS v, received_at, obs_id FROM panel
  WHERE regexp_full_match(entity_id, 'N[A-Z]{{4}}') AND name IN {PANEL_NAMES} AND obs_date IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)),
name_range AS (SELECT name, {FENCE.format("n")} FROM cells GROUP BY 1),
codes AS (SELECT v FROM cells JOIN name_range USING (name) WHERE v < na - 3 * nw OR v > nb + 3 * nw GROUP BY v
  HAVING count(DISTINCT series_id) >= greatest(2, (SELECT count(DISTINCT series_id) FROM cells) / 1000)),
series_range AS (SELECT series_id, {FENCE.format("s")} FROM cells WHERE v NOT IN (SELECT v FROM codes) GROUP BY 1),
panel_series AS (
  SELECT series_id, name, freq, ts, arg_max(v, (coalesce(received_at, TIMESTAMP '0001-01-01'), obs_id)) AS value
  FROM cells JOIN name_range USING (name) LEFT JOIN series_range USING (series_id)
  WHERE NOT ((v IN (SELECT v FROM codes) AND (v < na - 3 * nw OR v > nb + 3 * nw) AND coalesce(v < sa - 3 * sw OR v > sb + 3 * sw, true))
    OR (abs(v - nm) > 100 * nw AND coalesce(abs(v - sm) > 100 * sw, true)))
  GROUP BY 1, 2, 3, 4)"""


def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, ts, label: the regime of a day by its last recorded row, whatever its spelling; NULL and blank labels are none."""
    rows = table(spark, sf_dir, "regime_history").select("symbol", F.col("ts").cast("date").alias("ts"), F.col("regime").alias("spelling"), "recorded_at", "row_id")
    rows = rows.where("symbol is not null and ts is not null").where(F.col("spelling").rlike(r"\S"))
    last = rows.groupBy(F.col("symbol").alias("series_id"), "ts").agg(F.max_by("spelling", F.struct("recorded_at", "row_id")).alias("spelling"))
    return last.select("series_id", "ts", keys_of(F.col("spelling"), LABELS, LABEL_FILLERS).alias("label"))


REGIMES = r"""spelt AS (
  SELECT symbol AS series_id, CAST(ts AS DATE) AS ts, recorded_at, row_id,
    regexp_replace(regexp_replace(' ' || regexp_replace(lower(strip_accents(regime)), '[^a-z0-9]+', ' ', 'g') || ' ', ' (market|regime) ', ' ', 'g'), ' ', '', 'g') AS bare
  FROM regime_history WHERE symbol IS NOT NULL AND ts IS NOT NULL AND trim(regime, E' \t\n\r') <> ''),
nearest AS (
  SELECT bare, list_sort([{'d': damerau_levenshtein(bare, l.name), 'k': l.k, 'name': l.name, 'most': l.most} FOR l IN
    [{'k': 0, 'name': 'bull', 'most': 1}, {'k': 1, 'name': 'bear', 'most': 1}, {'k': 2, 'name': 'crisis', 'most': 2}, {'k': 3, 'name': 'sideways', 'most': 2}, {'k': 4, 'name': 'unknown', 'most': 2}]])[1] AS b
  FROM (SELECT DISTINCT bare FROM spelt)),
labels AS (
  SELECT series_id, ts, arg_max(CASE WHEN b.d <= b.most THEN b.name ELSE bare END, (coalesce(recorded_at, TIMESTAMP '0001-01-01'), row_id)) AS label
  FROM spelt JOIN nearest USING (bare) GROUP BY 1, 2)"""
