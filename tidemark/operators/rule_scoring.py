"""Scoring documents against rules that are data: keywords, expected elements and weights per rule.

A document is multiplied by the rules only inside its own row (an array of structs), scored by expressions, and rolled up by
one aggregate; the rules table is small and its size is checked before it is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.text import keyword_score
from tidemark.session import broadcast_bounded

# Component weights, risk and maturity limits, weight of an unlisted rule, weight from which a rule is critical.
COMPONENTS = (0.3, 0.4, 0.3)
RISK_LIMITS = (0.70, 0.40)
MATURITY_LIMITS = (0.95, 0.8, 0.6, 0.4)
DEFAULT_WEIGHT, CRITICAL_WEIGHT = 0.5, 0.85
RULE_SCHEMA = "rule string, name string, required boolean, risk_if_missing string, keywords array<string>, elements array<string>, weight double"


@dataclass(frozen=True)
class Rule:
    """One rule; a rule without its own weight counts with DEFAULT_WEIGHT."""

    rule: str
    name: str
    keywords: tuple[str, ...]
    elements: tuple[str, ...]
    weight: float | None = None
    required: bool = True
    risk_if_missing: str = "medium"


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a DataFrame."""
    return spark.createDataFrame([(r.rule, r.name, r.required, r.risk_if_missing, list(r.keywords), list(r.elements), r.weight) for r in rules], RULE_SCHEMA)


def with_weights(rules: DataFrame, weights: DataFrame) -> DataFrame:
    """Rules with their weight looked up (rule, weight); DEFAULT_WEIGHT where there is none."""
    return rules.drop("weight").join(weights, "rule", "left").withColumn("weight", F.coalesce("weight", F.lit(DEFAULT_WEIGHT)))


def clip(x: Column) -> Column:
    """Into 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def presence(status: Column, confidence: Column) -> Column:
    """0.8..1 if present, 0.4..0.7 if partial, by confidence; 1 if not applicable, else 0."""
    return F.when(status == "present", F.least(F.lit(1.0), 0.8 + 0.2 * confidence)).when(status == "partial", 0.4 + 0.3 * confidence).when(status == "n/a", 1.0).otherwise(0.0)


def similarity(text: Column, keywords: Column) -> Column:
    """0 under 20 characters, else six parts keyword score and four parts length up to 500 characters."""
    length = F.char_length(F.trim(text))
    return F.when(length < 20, 0.0).otherwise(0.6 * keyword_score(text, keywords) + 0.4 * F.least(F.lit(1.0), F.char_length(text) / 500))


def completeness(found: Column, missing: Column) -> Column:
    """Found elements over all; 0.5 if there are none."""
    total = F.size(found) + F.size(missing)
    return F.when(total == 0, 0.5).otherwise(F.size(found) / total)


def component_score(p: Column, s: Column, c: Column, weights: tuple[float, float, float] = COMPONENTS) -> Column:
    """Weighted sum; weights that don't add up to 1 (within 0.01) are scaled."""
    total = sum(weights)
    a, b, d = weights if abs(total - 1) <= 0.01 else tuple(x / total for x in weights)
    return a * p + b * s + d * c


def risk(score: Column, limits: tuple[float, float] = RISK_LIMITS) -> Column:
    """low, medium or high."""
    return F.when(score >= limits[0], "low").when(score >= limits[1], "medium").otherwise("high")


def maturity(score: Column) -> Column:
    """5 down to 1."""
    out = None
    for level, limit in zip((5, 4, 3, 2), MATURITY_LIMITS, strict=True):
        out = F.when(score >= limit, level) if out is None else out.when(score >= limit, level)
    return out.otherwise(1)


def risk_order(level: Column) -> Column:
    """high before medium before low."""
    return F.when(level == "high", 0).when(level == "medium", 1).otherwise(2)


def keyword_extraction(documents: DataFrame, rules: DataFrame, doc_id: str, text: str, max_rules: int = 5000) -> DataFrame:
    """doc, rule, weight, status, confidence, similarity, found, missing: the offline extractor.

    An element is found if every word of it of four letters or more occurs; confidence is the keyword score; status is
    present from 0.5, partial above 0, else missing. Another extractor may give the same columns instead.
    """
    packed = broadcast_bounded(rules.agg(F.collect_list(F.struct("rule", "keywords", "elements", F.coalesce("weight", F.lit(DEFAULT_WEIGHT)).alias("weight"))).alias("rules")), max_rules)
    each = documents.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).crossJoin(packed)  # one row of rules
    low = F.lower(F.col("text"))
    words = lambda e: F.filter(F.split(F.lower(e), r"[^\p{L}]+"), lambda w: F.char_length(w) >= 4)
    scored = each.select("doc", "text", F.explode("rules").alias("r")).withColumn("confidence", keyword_score(F.col("text"), F.col("r.keywords")))
    found = F.filter("r.elements", lambda e: F.forall(words(e), lambda w: F.contains(low, w)))
    return scored.select(
        "doc", F.col("r.rule").alias("rule"), F.col("r.weight").alias("weight"), "confidence",
        F.when(F.col("confidence") >= 0.5, "present").when(F.col("confidence") > 0, "partial").otherwise("missing").alias("status"),
        similarity(F.col("text"), F.col("r.keywords")).alias("similarity"), found.alias("found"), F.array_except("r.elements", found).alias("missing"),
    )


def rule_scores(extracted: DataFrame) -> DataFrame:
    """Adds presence, completeness, overall and risk."""
    p, c = presence(F.col("status"), F.col("confidence")), completeness(F.col("found"), F.col("missing"))
    return extracted.withColumn("presence", p).withColumn("completeness", c).withColumn("overall", component_score(F.col("presence"), F.col("similarity"), F.col("completeness"))).withColumn("risk", risk(F.col("overall")))


def document_scores(scored: DataFrame) -> DataFrame:
    """One row per document: weighted score, its critical part (1 without critical rules), counts, coverage, exposure, maturity, risk.

    A rule that doesn't apply counts as missing among the counts. exposure: weight of missing critical rules over all critical.
    """
    critical = F.col("weight") >= CRITICAL_WEIGHT
    total = lambda c: F.sum(c)
    rows = scored.groupBy("doc").agg(
        F.count(F.lit(1)).alias("rules"), F.try_divide(total(F.col("overall") * F.col("weight")), total("weight")).alias("score"),
        F.coalesce(F.try_divide(total(F.when(critical, F.col("overall") * F.col("weight"))), total(F.when(critical, F.col("weight")))), F.lit(1.0)).alias("critical_score"),
        F.count_if(F.col("status") == "present").alias("present"), F.count_if(F.col("status") == "partial").alias("partial"), F.count_if(~F.col("status").isin("present", "partial")).alias("missing"),
        F.count_if(F.col("risk") == "high").alias("high"), F.count_if(F.col("risk") == "medium").alias("medium"), F.count_if(F.col("risk") == "low").alias("low"),
        F.coalesce(F.try_divide(total(F.when(critical & (F.col("status") == "missing"), F.col("weight"))), total(F.when(critical, F.col("weight")))), F.lit(0.0)).alias("exposure"),
    )
    return rows.withColumn("coverage", (F.col("present") + 0.5 * F.col("partial")) / F.col("rules") * 100).withColumn("maturity", maturity(F.col("score"))).withColumn("risk", risk(F.col("score")))


def ranked_findings(scored: DataFrame, most: int = 10) -> DataFrame:
    """doc, place, rule, text: up to most findings of high or medium risk per document, worst risk and lowest score first."""
    w = W.partitionBy("doc").orderBy(risk_order(F.col("risk")), "overall", "rule")
    rows = scored.where("risk <> 'low'").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    gaps = F.array_join(F.slice("missing", 1, 3), ", ")
    return rows.select("doc", "place", "rule", F.when(F.col("status") == "missing", F.concat(F.lit("Add: "), "rule")).otherwise(F.concat(F.lit("Complete: "), "rule", F.lit(" ("), gaps, F.lit(")"))).alias("text"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 1 for two empty sets, 0 if one is empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def classification_quality(rows: DataFrame, predicted: str, truth: str, keys: list[str], target_recall: float = 0.8) -> DataFrame:
    """keys, tp, fp, fn, precision, recall, f1, precision_at_recall (0 if recall stays under the target)."""
    p, t = F.col(predicted), F.col(truth)
    c = rows.groupBy(*keys).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), F.lit(0.0))
    c = c.withColumn("precision", ratio("tp", "fp")).withColumn("recall", ratio("tp", "fn"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return c.withColumn("f1", f1).withColumn("precision_at_recall", F.when(F.col("recall") >= target_recall, F.col("precision")).otherwise(0.0))
