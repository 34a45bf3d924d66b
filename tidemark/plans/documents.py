"""Queries on texts and rule scoring, over the contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.model import table
from tidemark.operators import report
from tidemark.operators import rule_scoring as rs
from tidemark.operators import text as tx
from tidemark.operators.rule_scoring import Rule
from tidemark.plans.base import Registry, shown

R = Registry()
# Rules for this project's contracts, as data; another set comes from a file, see sources.config.
RULES = [
    Rule("confidentiality", "Confidentiality", ("keep confidential", "personal data", "Confidential"), ("personal data handled", "record of access"), 0.9, True, "high"),
    Rule("audit", "Audit", ("audit", "record of access"), ("may audit", "service levels"), 0.45, False, "low"),
    Rule("payment", "Payment", ("invoice", "sums overdue", "annual charge", "crowns"), ("sums overdue by more", "without undue delay"), 0.7),
    Rule("assignment", "Assignment", ("may not assign", "assignee"), ("source materials", "derived files"), 0.5, False, "low"),
    Rule("liability", "Liability", ("indemnify", "insurance cover", "bear the cost"), ("insurance cover", "claim arising"), 0.9, True, "high"),
    Rule("term", "Term", ("whole term", "during the term", "working days"), ("months after",)),
]
RULES_SQL = "(VALUES " + ", ".join(f"('{r.rule}', {list(r.keywords)!r}, {list(r.elements)!r}, {rs.DEFAULT_WEIGHT if r.weight is None else r.weight}::DOUBLE)" for r in RULES) + ") r(rule, keywords, elements, weight)"
KW = "len([k FOR k IN keywords IF contains(lower(text), lower(k))])::DOUBLE / len(keywords)"
SCORED = f"""WITH d AS (SELECT contract_id AS doc, coalesce(contract_text, '') AS text FROM contracts), b AS (SELECT doc, text, rule, keywords, elements, weight, {KW} AS confidence FROM d, {RULES_SQL}),
x AS (SELECT doc, rule, weight, confidence, CASE WHEN confidence >= 0.5 THEN 'present' WHEN confidence > 0 THEN 'partial' ELSE 'missing' END AS status,
  CASE WHEN length(trim(text)) < 20 THEN 0 ELSE 0.6 * confidence + 0.4 * least(1.0, length(text) / 500.0) END AS similarity, len(elements) AS n,
  [e FOR e IN elements IF len([w FOR w IN regexp_split_to_array(lower(e), '[^a-z]+') IF length(w) >= 4 AND NOT contains(lower(text), w)]) = 0] AS found, elements FROM b),
y AS (SELECT *, CASE WHEN status = 'present' THEN least(1.0, 0.8 + 0.2 * confidence) WHEN status = 'partial' THEN 0.4 + 0.3 * confidence ELSE 0 END AS presence, CASE WHEN n = 0 THEN 0.5 ELSE len(found)::DOUBLE / n END AS completeness FROM x),
s AS (SELECT *, 0.3 * presence + 0.4 * similarity + 0.3 * completeness AS overall FROM y), z AS (SELECT *, CASE WHEN overall >= 0.7 THEN 'low' WHEN overall >= 0.4 THEN 'medium' ELSE 'high' END AS risk FROM s)"""


def contracts(spark, sf_dir):
    return table(spark, sf_dir, "contracts").select("contract_id", "contract_text")


def scored(spark, sf_dir):
    return rs.rule_scores(rs.keyword_extraction(contracts(spark, sf_dir), rs.rules_table(spark, RULES), "contract_id", "contract_text"))


@R.query("doc_metadata", r"""SELECT contract_id AS doc, CAST(len([w FOR w IN regexp_split_to_array(coalesce(contract_text, ''), '[ \t\n\r\f\v]+') IF w <> '']) AS BIGINT) AS word_count, CAST(length(coalesce(contract_text, '')) AS BIGINT) AS character_count, CAST(strlen(coalesce(contract_text, '')) AS BIGINT) AS byte_size, 'en' AS language FROM contracts""")
def doc_metadata(spark, sf_dir):
    """Words, characters and bytes."""
    return tx.metadata(contracts(spark, sf_dir), "contract_id", "contract_text")


@R.query("keyword_score", f"WITH d AS (SELECT contract_id AS doc, coalesce(contract_text, '') AS text FROM contracts) SELECT doc, rule, round_even({KW}, 6) AS score FROM d, {RULES_SQL}")
def keyword_score(spark, sf_dir):
    """Share of keywords found, per document and rule."""
    x = rs.keyword_extraction(contracts(spark, sf_dir), rs.rules_table(spark, RULES), "contract_id", "contract_text")
    return shown(x.select("doc", "rule", F.col("confidence").alias("score")))


@R.query("truncate_middle", "SELECT contract_id, length(contract_text) AS n, CASE WHEN length(contract_text) > 8000 THEN left(contract_text, 4000) || '[..]' || right(contract_text, 4000) ELSE contract_text END AS shortened, CASE WHEN length(contract_text) > 300 THEN left(contract_text, 300) || '...' ELSE contract_text END AS head FROM contracts")
def truncate_middle(spark, sf_dir):
    """Truncation in the middle and at the end."""
    t = F.col("contract_text")
    return contracts(spark, sf_dir).select("contract_id", F.char_length(t).cast("long").alias("n"), tx.truncate_middle(t, 8000, "[..]").alias("shortened"), tx.truncate_end(t, 300, "...").alias("head"))


STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
HEADER_SQL = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(line, '{h}') THEN {STRIP(f"regexp_extract(line, '{h}', 1)")} END" for h in tx.HEADERS) + ")"


@R.query("sections", f"""WITH l AS (SELECT contract_id AS doc, unnest(string_split(coalesce(contract_text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(contract_text, ''), chr(10)), 1) AS i FROM contracts),
h AS (SELECT *, {HEADER_SQL} AS name FROM l), g AS (SELECT *, sum(CASE WHEN name IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY i) AS sec FROM h),
s AS (SELECT doc, sec, coalesce(max(name), 'PREAMBLE') AS section, {STRIP("string_agg(CASE WHEN name IS NULL THEN line END, chr(10) ORDER BY i)")} AS content FROM g GROUP BY 1, 2)
SELECT doc, section, arg_max(content, sec) AS content FROM s WHERE content IS NOT NULL GROUP BY 1, 2""")
def sections(spark, sf_dir):
    """Sections by header lines."""
    return tx.sections(contracts(spark, sf_dir), "contract_id", "contract_text")


@R.query("keyword_hits", "SELECT contract_id, CAST(CASE WHEN contract_text IS NULL THEN NULL ELSE (length(lower(contract_text)) - length(replace(lower(contract_text), 'audit', ''))) // 5 END AS BIGINT) AS hits FROM contracts")
def keyword_hits(spark, sf_dir):
    """Occurrences of a keyword."""
    return contracts(spark, sf_dir).select("contract_id", tx.hit_count(F.col("contract_text"), "audit").cast("long").alias("hits"))


@R.query("keyword_in_context")
def keyword_in_context(spark, sf_dir):
    """Passages around keywords."""
    return tx.keyword_in_context(contracts(spark, sf_dir), "contract_id", "contract_text", ["indemnify", "trifling"], 80)


ANSWER_SQL = """WITH a AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"status": "Present", "confidence": ' || value || ', "found_elements": ["a"]}' WHEN 1 THEN 'Here: {"status": "partial", "confidence": 0.25} ok' WHEN 2 THEN 'no answer' ELSE props END AS text FROM events)"""


@R.query("json_normalise", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'present' WHEN 1 THEN 'partial' ELSE 'missing' END AS status, round_even(CASE event_id % 4 WHEN 0 THEN greatest(0, least(1, value)) WHEN 1 THEN 0.25 ELSE 0 END, 6) AS confidence,
CAST(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS found, 2 AS missing FROM events""")
def json_normalise(spark, sf_dir):
    """Answers parsed with fallbacks and defaults."""
    kind = F.pmod("event_id", F.lit(4))
    text = (
        F.when(kind == 0, F.concat(F.lit('{"status": "Present", "confidence": '), F.col("value").cast("string"), F.lit(', "found_elements": ["a"]}')))
        .when(kind == 1, '```json\n{"status": "partial", "confidence": 0.25}\n```').when(kind == 2, "no answer").otherwise(F.col("props"))
    )
    expected = F.array(F.lit("a"), F.lit("b"))
    a = table(spark, sf_dir, "events").select("event_id", tx.normalise_answer(tx.parse_answer(text), expected).alias("a"))
    return shown(a.select("event_id", "a.status", "a.confidence", F.size("a.found_elements").alias("found"), F.size("a.missing_elements").alias("missing")))


@R.query("events_json_props", "SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def events_json_props(spark, sf_dir):
    """Fields out of landed JSON."""
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))


@R.query("clause_scores", SCORED + " SELECT doc, rule, status, round_even(presence, 6) AS presence, round_even(similarity, 6) AS similarity, round_even(completeness, 6) AS completeness, round_even(overall, 6) AS overall, risk FROM z")
def clause_scores(spark, sf_dir):
    """K1 to K6: component scores and risk of every document and rule."""
    return shown(scored(spark, sf_dir).select("doc", "rule", "status", "presence", "similarity", "completeness", "overall", "risk"))


@R.query("doc_compliance", SCORED + """, r AS (SELECT doc, count(*) AS rules, sum(overall * weight) / sum(weight) AS score, coalesce(sum(CASE WHEN weight >= 0.85 THEN overall * weight END) / sum(CASE WHEN weight >= 0.85 THEN weight END), 1) AS critical_score,
  count_if(status = 'present') AS present, count_if(status = 'partial') AS partial, count_if(status NOT IN ('present', 'partial')) AS missing, coalesce(sum(CASE WHEN weight >= 0.85 AND status = 'missing' THEN weight END) / sum(CASE WHEN weight >= 0.85 THEN weight END), 0) AS exposure FROM z GROUP BY 1)
SELECT doc, rules, round_even(score, 4) AS score, round_even(critical_score, 4) AS critical_score, present, partial, missing, round_even(exposure, 4) AS exposure, round_even((present + 0.5 * partial) / rules * 100, 4) AS coverage,
  CAST(CASE WHEN score >= 0.95 THEN 5 WHEN score >= 0.8 THEN 4 WHEN score >= 0.6 THEN 3 WHEN score >= 0.4 THEN 2 ELSE 1 END AS INTEGER) AS maturity, CASE WHEN score >= 0.7 THEN 'low' WHEN score >= 0.4 THEN 'medium' ELSE 'high' END AS risk FROM r""")
def doc_compliance(spark, sf_dir):
    """Document scores."""
    return shown(rs.document_scores(scored(spark, sf_dir)).drop("high", "medium", "low"), 4)


@R.query("recommendations_top10", SCORED + """, k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY CASE risk WHEN 'high' THEN 0 ELSE 1 END, overall, rule) AS place FROM z WHERE risk <> 'low')
SELECT doc, CAST(place AS INTEGER) AS place, rule, CASE WHEN status = 'missing' THEN 'Add: ' || rule ELSE 'Complete: ' || rule || ' (' || array_to_string([e FOR e IN elements IF NOT list_contains(found, e)][1:3], ', ') || ')' END AS text FROM k WHERE place <= 10""")
def recommendations_top10(spark, sf_dir):
    """Ranked findings."""
    return rs.ranked_findings(scored(spark, sf_dir))


@R.query("batch_summary", SCORED + """, r AS (SELECT doc, sum(overall * weight) / sum(weight) AS score FROM z GROUP BY 1) SELECT c.filename, round_even(score, 4) AS score, CASE WHEN score >= 0.7 THEN 'low' WHEN score >= 0.4 THEN 'medium' ELSE 'high' END AS risk, c.contract_id FROM r JOIN contracts c ON c.contract_id = r.doc""")
def batch_summary(spark, sf_dir):
    """One line per file."""
    names = table(spark, sf_dir, "contracts").select(F.col("contract_id").alias("doc"), "filename")
    return shown(rs.document_scores(scored(spark, sf_dir)).join(names, "doc").select("filename", "score", "risk", F.col("doc").alias("contract_id")), 4)


@R.query("precision_recall_f1", SCORED + """, c AS (SELECT rule, count_if(overall >= 0.7 AND status = 'present') AS tp, count_if(overall >= 0.7 AND status <> 'present') AS fp, count_if(overall < 0.7 AND status = 'present') AS fn FROM z GROUP BY 1),
q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c)
SELECT rule, tp, fp, fn, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall, round_even(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, round_even(CASE WHEN recall >= 0.8 THEN precision ELSE 0 END, 6) AS precision_at_recall FROM q""")
def precision_recall_f1(spark, sf_dir):
    """Quality of a threshold against a status."""
    rows = scored(spark, sf_dir).withColumn("said", F.col("overall") >= 0.7).withColumn("is_so", F.col("status") == "present")
    return shown(rs.classification_quality(rows, "said", "is_so", ["rule"]))


@R.query("jaccard", SCORED + """ SELECT doc, rule, round_even(CASE WHEN len(found) = 0 AND len(elements) = 0 THEN 1 WHEN len(found) = 0 OR len(elements) = 0 THEN 0 ELSE len([e FOR e IN found IF list_contains(elements, e)])::DOUBLE / len(elements) END, 6) AS jaccard FROM z""")
def jaccard(spark, sf_dir):
    """Overlap of found and expected elements."""
    s = scored(spark, sf_dir)
    return shown(s.select("doc", "rule", rs.jaccard(F.col("found"), F.array_union("found", "missing")).alias("jaccard")))


@R.query("doc_report_markdown")
def doc_report_markdown(spark, sf_dir):
    """A Markdown report per document."""
    s = scored(spark, sf_dir)
    return report.document_markdown(rs.document_scores(s), rs.ranked_findings(s))


@R.query("batch_report_lines", SCORED + """, r AS (SELECT doc, sum(overall * weight) / sum(weight) AS score FROM z GROUP BY 1) SELECT '| ' || c.filename || ' | ' || printf('%.4f', round_even(score, 4)) || ' | ' || CASE WHEN score >= 0.7 THEN 'low' WHEN score >= 0.4 THEN 'medium' ELSE 'high' END || ' |' AS line, c.contract_id FROM r JOIN contracts c ON c.contract_id = r.doc""")
def batch_report_lines(spark, sf_dir):
    """The lines of the batch report."""
    names = table(spark, sf_dir, "contracts").select(F.col("contract_id").alias("doc"), "filename")
    d = rs.document_scores(scored(spark, sf_dir)).withColumn("score", F.col("score") + 3.1e-9).join(names, "doc")
    return report.batch_lines(d).select("line", F.col("doc").alias("contract_id"))
