"""Text operators: metadata, keyword scores, truncation, sections, keyword in context, parsing of model answers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Forms of a header line, tried in this order; the first group is the section's name.
HEADERS = (
    r"^(\d+\.?\s*[A-Z][A-Za-z\s]+):",
    r"^(ARTICLE\s+[IVX\d]+[:\s]+[A-Za-z\s]+)",
    r"^([A-Z][A-Z\s]{3,}):",
)
ANSWER = "found boolean, status string, extracted_text string, found_elements array<string>, missing_elements array<string>, confidence double, issues array<string>"


def metadata(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, word_count (parts between white space), character_count (code points), byte_size, language; NULL texts count 0."""
    t = F.coalesce(F.col(text), F.lit(""))
    return documents.select(
        F.col(doc_id).alias("doc"), F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")).cast("long").alias("word_count"), F.char_length(t).cast("long").alias("character_count"),
        F.octet_length(t).cast("long").alias("byte_size"), F.lit("en").alias("language"),
    )


def keyword_score(text: Column, keywords: Column) -> Column:
    """Share of the keywords that are case-insensitive substrings of the text; 0 for no keywords or no text."""
    low = F.lower(text)
    hits = F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k))))
    return F.coalesce(F.when(F.size(keywords) > 0, hits / F.size(keywords)), F.lit(0.0))


def truncate_middle(text: Column, limit: int = 8000, marker: str = "\n\n[... middle of the text left out ...]\n\n") -> Column:
    """The text, or its first and last limit/2 characters around a marker if it is longer."""
    half = limit // 2
    return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(half)), F.lit(marker), F.right(text, F.lit(half)))).otherwise(text)


def truncate_end(text: Column, limit: int, tail: str = "") -> Column:
    """The first limit characters, with a tail if there were more."""
    return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(tail))).otherwise(text)


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sections(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, section, content: lines under each header line; PREAMBLE before the first. A header with no line under it is
    left out, of equal headers the last holds. One document's lines stay inside its row: arrays folded in the JVM."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    none = F.array().cast("array<string>")
    init = F.struct(F.struct(F.lit("PREAMBLE").alias("name"), none.alias("lines")).alias("now"), F.array().cast("array<struct<name:string,lines:array<string>>>").alias("done"))

    def step(acc: Column, line: Column) -> Column:
        name = F.coalesce(*[F.when(line.rlike(h), stripped(F.regexp_extract(line, h, 1))) for h in HEADERS])
        opened = F.struct(F.struct(name.alias("name"), none.alias("lines")).alias("now"), F.concat(acc["done"], F.array(acc["now"])).alias("done"))
        grown = F.struct(F.struct(acc["now"]["name"].alias("name"), F.concat(acc["now"]["lines"], F.array(line)).alias("lines")).alias("now"), acc["done"].alias("done"))
        return F.when(name.isNotNull(), opened).otherwise(grown)

    folded = F.aggregate(lines, init, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))
    rows = documents.select(F.col(doc_id).alias("doc"), F.posexplode(folded).alias("place", "s")).where(F.size("s.lines") > 0)
    rows = rows.select("doc", "place", F.col("s.name").alias("section"), stripped(F.array_join("s.lines", "\n")).alias("content"))
    return rows.groupBy("doc", "section").agg(F.max_by("content", "place").alias("content"))


def in_context(text: str, keywords: list[str], around: int = 500) -> list[str]:
    """Passages around every hit of every keyword, widened to sentence ends, first-seen order, without repeats."""
    low, out = text.lower(), {}
    for word in keywords:
        at = low.find(word.lower()) if word else -1
        while at >= 0:
            a, b = max(0, at - around), min(len(text), at + len(word) + around)
            before = max(text.rfind(c, 0, a) for c in ".!?\n")
            after = [p for p in (text.find(c, b) for c in ".!?\n") if p >= 0]
            out.setdefault(text[before + 1 : (min(after) + 1 if after else len(text))].strip(), None)
            at = low.find(word.lower(), at + 1)
    return list(out)


def keyword_in_context(documents: DataFrame, doc_id: str, text: str, keywords: list[str], around: int = 500) -> DataFrame:
    """doc, passage of in_context, in Arrow batches; documents without a hit give no rows and never reach Python."""

    @F.pandas_udf("array<string>")
    def passages(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: in_context(t, keywords, around))

    any_hit = F.lower(F.col(text)).rlike("|".join(re.escape(k.lower()) for k in keywords))
    return documents.where(any_hit).select(F.col(doc_id).alias("doc"), F.explode(passages(F.col(text))).alias("passage"))


def hit_count(text: Column, keyword: str) -> Column:
    """Overlapping case-insensitive occurrences."""
    return F.regexp_count(F.lower(text), F.lit(f"(?={re.escape(keyword.lower())})"))


def parse_answer(answer: Column) -> Column:
    """Struct of ANSWER from a model's text: the whole text as JSON, else the first flat {...} that is JSON, else the first
    with one nested level; NULL if there is none."""
    valid = lambda c: F.json_object_keys(c).isNotNull()
    first = lambda pattern: F.get(F.filter(F.regexp_extract_all(answer, F.lit(pattern), F.lit(0)), valid), F.lit(0))
    whole = F.when(valid(answer), answer)
    return F.from_json(F.coalesce(whole, first(r"\{[^{}]*\}"), first(r"\{(?:[^{}]|\{[^{}]*\})*\}")), ANSWER, {"mode": "PERMISSIVE"})


def normalise_answer(parsed: Column, expected: Column) -> Column:
    """Defaults for what an answer leaves out: status missing, all elements missing, confidence within 0..1 (0 if not given)."""
    status = F.lower(parsed["status"])
    known = F.when(status.isin("present", "partial", "missing", "n/a"), status).otherwise("missing")
    empty = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(known, F.lit("missing")).alias("status"), F.coalesce(parsed["extracted_text"], F.lit("")).alias("extracted_text"), F.coalesce(parsed["found_elements"], empty).alias("found_elements"),
        F.coalesce(parsed["missing_elements"], expected).alias("missing_elements"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(parsed["confidence"], F.lit(0.0)))).alias("confidence"),
        F.coalesce(parsed["issues"], empty).alias("issues"),
    )
