"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.event_runs import event_runs
from tidemark.llm.leaks import leaked_items
from tidemark.llm.mixing import in_order, mix_sources
from tidemark.llm.splitting import split_texts
from tidemark.llm.toxicity import Classifier, fit_documents, rates, score_documents
from tidemark.model import table

DAY_US = 86_400_000_000
# The regimes' labels, and words that say nothing about which regime it is.
REGIMES = ("bull", "bear", "crisis", "sideways", "unknown")
REGIME_FILLERS = ("market", "regime")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all contracts."""
    return split_texts(table(spark, sf_dir, "contracts"), "contract_id", "contract_text").select(
        F.col("doc").alias("contract_id"), F.col("piece").alias("piece_no"), "start", F.col("piece_text").alias("text"), "ends_at"
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts that came out in more than one piece, and those among them where a cut had to go through a line over the limit."""
    pieces = split_texts(table(spark, sf_dir, "contracts"), "contract_id", "contract_text")
    seen = pieces.groupBy("doc").agg(F.max("piece").alias("pieces"), F.max("through").alias("through"))
    what = F.array_compact(F.array(F.when(F.col("pieces") > 1, "oversized"), F.when(F.col("through") > 8000, "unbroken")))
    return seen.select(F.col("doc").alias("contract_id"), F.explode(what).alias("what"))


P3_FOUND_SQL = """
WITH c AS (SELECT contract_id, length(contract_text) AS n, list_max([length(x) FOR x IN regexp_split_to_array(contract_text, '[\\n\\r\\f]')]) AS stretch FROM contracts)
SELECT contract_id, 'oversized' AS what FROM c WHERE n > 8000
UNION ALL SELECT contract_id, 'unbroken' FROM c WHERE n > 8000 AND stretch > 8000
"""


def _regime_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_runs(table(spark, sf_dir, "regime_history"), "symbol", "ts", "regime", ("recorded_at", "row_id"), REGIMES, REGIME_FILLERS)


def _day(us: str):
    return F.date_format(F.timestamp_micros(F.col(us)), "yyyy-MM-dd")


def p6_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run with regime, first and last day, number of days reported and days from first to last."""
    return _regime_runs(spark, sf_dir).select(
        F.col("entity").alias("symbol"), F.col("label").alias("regime"), _day("start_us").alias("start_day"), _day("end_us").alias("end_day"), "n_events",
        F.expr(f"duration_us div {DAY_US} + 1").alias("duration_days"),
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with at least two different times."""
    runs = _regime_runs(spark, sf_dir).where("n_events >= 2")
    return runs.select(F.col("entity").alias("symbol"), _day("start_us").alias("start_day"), _day("end_us").alias("end_day"), F.col("n_events").cast("int").alias("n_events"))


P6_BASE = r"""
WITH words AS (
  SELECT symbol, ts, recorded_at, row_id, regexp_replace(regexp_replace(' ' || regexp_replace(lower(strip_accents(regime)), '[^a-z0-9]+', ' ', 'g') || ' ', ' (market|regime) ', ' ', 'g'), ' ', '', 'g') AS bare
  FROM regime_history WHERE symbol IS NOT NULL AND ts IS NOT NULL AND trim(regime, E' \t\n\r') <> ''),
near AS (
  SELECT bare, list_sort([{'d': damerau_levenshtein(bare, l.name), 'k': l.k, 'name': l.name, 'most': l.most} FOR l IN
    [{'k': 0, 'name': 'bull', 'most': 1}, {'k': 1, 'name': 'bear', 'most': 1}, {'k': 2, 'name': 'crisis', 'most': 2}, {'k': 3, 'name': 'sideways', 'most': 2}, {'k': 4, 'name': 'unknown', 'most': 2}]])[1] AS b
  FROM (SELECT DISTINCT bare FROM words)),
labelled AS (SELECT symbol, ts, recorded_at, row_id, CASE WHEN b.d <= b.most THEN b.name ELSE bare END AS label FROM words JOIN near USING (bare)),
once AS (SELECT symbol, ts, arg_max(label, (coalesce(recorded_at, TIMESTAMP '0001-01-01'), row_id)) AS label FROM labelled GROUP BY 1, 2),
flagged AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY symbol ORDER BY ts) THEN 1 ELSE 0 END AS opens FROM once),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY symbol ORDER BY ts) AS run FROM flagged)
"""
P6_FOUND_SQL = P6_BASE + """
SELECT symbol, strftime(min(ts), '%Y-%m-%d') AS start_day, strftime(max(ts), '%Y-%m-%d') AS end_day, CAST(count(*) AS INTEGER) AS n_events
FROM numbered GROUP BY symbol, run HAVING count(*) >= 2
"""
P6_RUNS_SQL = P6_BASE + """
SELECT symbol, any_value(label) AS regime, strftime(min(ts), '%Y-%m-%d') AS start_day, strftime(max(ts), '%Y-%m-%d') AS end_day, count(*) AS n_events,
  date_diff('day', min(ts), max(ts)) + 1 AS duration_days FROM numbered GROUP BY symbol, run
"""

def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items that leaked into them."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with repeats, in order of virtual finish time."""
    mixture = mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return in_order(mixture).select(F.col("doc").alias("doc_id"), "source", "copy", "tokens", F.round("finish", 3).alias("finish"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's target and actual share."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).report


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their share."""
    return p8_shares(spark, sf_dir).where(~F.col("reachable")).select("source")


#: Classifiers by application and data folder: the three queries of a folder share one fit.
_FITTED: dict[tuple[str, str], Classifier] = {}


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "toxicity_labels")
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        _FITTED[key] = fit_documents(documents, labels)
    return score_documents(documents, labels, model=_FITTED[key])


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score."""
    return _scored(spark, sf_dir).withColumnRenamed("doc", "doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of flagged documents per source."""
    return rates(_scored(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged documents."""
    return _scored(spark, sf_dir).where("flagged").select(F.col("doc").alias("doc_id"))


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p6_found": p6_found, "p6_runs": p6_runs, "p7_found": p7_found, "p8_found": p8_found, "p8_chosen": p8_chosen, "p8_shares": p8_shares, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
ORACLES = {"p3_found": P3_FOUND_SQL, "p6_found": P6_FOUND_SQL, "p6_runs": P6_RUNS_SQL}
