"""Reports: quality, warnings, advice, summary text, Markdown and JSON, as expressions over one row per series.

Expected columns: series_id, regime, confidence, transition_risk, days, pipeline, reason, price, forecast, lower, upper,
passed, tests. NULL parts are left out of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quality(passed: Column, tests: Column) -> Column:
    """Share of tests passed; 0.5 if none was made."""
    return F.when(F.coalesce(tests, F.lit(0)) > 0, passed / tests).otherwise(0.5)


def quality_label(score: Column) -> Column:
    """HIGH from 0.8, MEDIUM from 0.6, LOW from 0.4."""
    return F.when(score >= 0.8, "HIGH").when(score >= 0.6, "MEDIUM").when(score >= 0.4, "LOW").otherwise("UNRELIABLE")


def percent(x: Column, digits: int = 0) -> Column:
    """0.256 as 26%."""
    return F.concat(F.format_number(F.bround(x * 100, digits), digits), F.lit("%"))


def warnings() -> Column:
    """What a reader should know, in order."""
    width = F.try_divide(F.col("upper") - F.col("lower"), F.abs("forecast"))
    failed = F.col("tests") - F.col("passed")
    return F.array_compact(
        F.array(
            F.when(F.col("transition_risk") > 0.2, F.concat(F.lit("Regime may change ("), percent(F.col("transition_risk")), F.lit(")"))),
            F.when(F.col("regime").isin("crisis", "bear"), F.concat(F.lit("In a "), "regime", F.lit(" regime forecasts are less certain"))),
            F.when(failed > 0, F.concat(failed.cast("string"), F.lit(" of "), F.col("tests").cast("string"), F.lit(" tests failed"))),
            F.when(width > 0.2, F.lit("Wide band around the forecast")),
        )
    )


# One line of advice per regime.
ADVICE = {"bear": ["Smaller positions suit a falling market"], "crisis": ["Defensive positions suit a crisis", "Watch volatility for a return to calm"], "bull": ["Following the trend may pay"], "sideways": ["Reverting to the mean may pay"]}


def advice(regime: Column) -> Column:
    """Lines for the regime; none for others."""
    out = None
    for name, lines in ADVICE.items():
        value = F.array(*[F.lit(x) for x in lines])
        out = F.when(regime == name, value) if out is None else out.when(regime == name, value)
    return out.otherwise(F.array().cast("array<string>"))


def with_report(facts: DataFrame) -> DataFrame:
    """Adds quality, quality_label, warnings, advice, summary and brief."""
    change = F.try_divide(F.col("forecast") - F.col("price"), F.col("price")) * 100
    r = facts.withColumn("quality", quality(F.col("passed"), F.col("tests"))).withColumn("quality_label", quality_label(F.col("quality"))).withColumn("warnings", warnings()).withColumn("advice", advice(F.col("regime")))
    lines = F.array_compact(
        F.array(
            F.concat(F.lit("Regime: "), "regime", F.lit(" ("), percent(F.col("confidence")), F.lit(")")),
            F.concat("series_id", F.lit(": "), F.format_number(F.bround("price", 2), 2), F.lit(" to "), F.format_number(F.bround("forecast", 2), 2), F.when(change >= 0, F.lit(" (+")).otherwise(F.lit(" (")), F.format_number(F.bround(change, 1), 1), F.lit("%)")),
            F.concat(F.lit("Confidence: "), "quality_label"),
            F.when(F.size("warnings") > 0, F.concat(F.lit("Note: "), F.array_join(F.slice("warnings", 1, 3), "; "))),
            F.when(F.col("tests") > 0, F.concat(F.lit("Tests: "), F.col("passed").cast("string"), F.lit("/"), F.col("tests").cast("string"))),
            F.when(F.col("transition_risk") > 0.15, F.concat(F.lit("Risk of a regime change within 14 days: "), percent(F.col("transition_risk")))),
        )
    )
    return r.withColumn("summary", F.array_join(lines, "\n")).withColumn("brief", F.array_join(lines, " "))


def markdown(report: DataFrame) -> DataFrame:
    """series_id, markdown."""
    bullets = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    parts = F.array_compact(
        F.array(
            F.concat(F.lit("# Report on "), "series_id"), F.concat(F.lit("## Summary\n\n"), "summary"),
            F.when(F.size("warnings") > 0, F.concat(F.lit("## Warnings\n\n"), bullets("warnings"))), F.when(F.size("advice") > 0, F.concat(F.lit("## Advice\n\n"), bullets("advice"))),
        )
    )
    return report.select("series_id", F.array_join(parts, "\n\n").alias("markdown"))


def as_json(report: DataFrame) -> DataFrame:
    """series_id, json: the whole row."""
    return report.select("series_id", F.to_json(F.struct(*[F.col(c) for c in report.columns])).alias("json"))


def backtest_text(metrics: DataFrame) -> DataFrame:
    """series_id, text: one line on n, mae, rmse, mape, direction, coverage."""
    n = lambda c, d: F.format_number(F.bround(c, d), d)
    return metrics.select("series_id", F.concat(F.col("n").cast("string"), F.lit(" periods, MAE "), n("mae", 2), F.lit(", MAPE "), n("mape", 2), F.lit("%, direction "), n("direction", 1), F.lit("%, coverage "), n("coverage", 1), F.lit("%")).alias("text"))


def save(report: DataFrame, path: str, kind: str = "json") -> None:
    """Write the report rows as json, parquet or text (one string column)."""
    if kind not in ("json", "parquet", "text"):
        raise ValueError("kind: json, parquet or text")
    getattr(report.write.mode("overwrite"), kind)(path)


def document_markdown(scores: DataFrame, findings: DataFrame) -> DataFrame:
    """doc, markdown of document scores (see rule_scoring) with their ranked findings; a table of counts and a list."""
    listed = findings.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("f"))
    r = scores.join(listed, "doc", "left")
    n = lambda c: F.col(c).cast("string")
    parts = F.array_compact(
        F.array(
            F.concat(F.lit("# Document "), n("doc")), F.concat(F.lit("Score "), F.format_number(F.bround("score", 4), 4), F.lit(", risk "), "risk", F.lit(", level "), n("maturity")),
            F.concat(F.lit("| present | partial | missing |\n| --- | --- | --- |\n| "), n("present"), F.lit(" | "), n("partial"), F.lit(" | "), n("missing"), F.lit(" |")),
            F.when(F.size("f") > 0, F.concat(F.lit("## To do\n\n"), F.array_join(F.transform("f", lambda x: F.concat(x["place"].cast("string"), F.lit(". "), x["text"])), "\n"))),
        )
    )
    return r.select("doc", F.array_join(parts, "\n\n").alias("markdown"))


def batch_lines(rows: DataFrame) -> DataFrame:
    """doc, score, line: the rows of a Markdown table of filename, score and risk, worst first; written as text they are the report."""
    line = F.concat(F.lit("| "), "filename", F.lit(" | "), F.format_number(F.bround("score", 4), 4), F.lit(" | "), "risk", F.lit(" |"))
    return rows.select("doc", "score", line.alias("line")).orderBy("score", "line")
