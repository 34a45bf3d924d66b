"""Extractors that ask a model over HTTP, as a partition-wise operator; failures become a column, never an error."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.text import truncate_middle
from tidemark.session import broadcast_bounded
from tidemark.sources.config import Settings

SCHEMA = "doc string, rule string, answer string, error string"


def prompts(documents: DataFrame, rules: DataFrame, doc_id: str, text: str, limit: int = 8000) -> DataFrame:
    """doc, rule, prompt: what to ask about every document and rule, the text shortened in its middle to limit characters."""
    packed = broadcast_bounded(rules.agg(F.collect_list(F.struct("rule", "name", "keywords", "elements")).alias("rules")), 1)
    each = documents.select(F.col(doc_id).cast("string").alias("doc"), truncate_middle(F.coalesce(F.col(text), F.lit("")), limit).alias("text")).crossJoin(packed)  # one row of rules
    r = each.select("doc", "text", F.explode("rules").alias("r"))
    question = F.concat(
        F.lit("Find the passage on: "), F.col("r.name"), F.lit("\nTypical words: "), F.array_join("r.keywords", ", "), F.lit("\nIt should state: "), F.array_join("r.elements", "; "),
        F.lit("\nAnswer in JSON with found, status (present, partial, missing), extracted_text, found_elements, missing_elements, confidence (0 to 1), issues.\n\nText:\n"), F.col("text"),
    )
    return r.select("doc", F.col("r.rule").alias("rule"), question.alias("prompt"))


def ask_http(settings: Settings) -> Callable[[str], str]:
    """One prompt to one answer; up to settings.retries tries a second apart, none after a client error."""

    def ask(prompt: str) -> str:
        body = json.dumps({"model": settings.model, "prompt": prompt, "stream": False}).encode()
        for left in range(settings.retries - 1, -1, -1):
            try:
                request = urllib.request.Request(f"{settings.base_url}/api/generate", body, {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=settings.timeout) as reply:
                    return json.load(reply).get("response", "")
            except urllib.error.HTTPError as e:
                if e.code < 500 or not left:
                    raise
            except OSError:
                if not left:
                    raise
            time.sleep(1)
        return ""

    return ask


def ask_all(questions: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """doc, rule, answer, error for rows of doc, rule, prompt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    rows.append((r.doc, r.rule, ask(r.prompt), None))
                except Exception as e:  # whatever the service does, the other rows go on
                    rows.append((r.doc, r.rule, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc", "rule", "answer", "error"])

    return questions.selectExpr("cast(doc as string) doc", "rule", "prompt").mapInPandas(run, SCHEMA)
