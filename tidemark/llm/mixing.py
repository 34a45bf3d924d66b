"""Mixing sources to target weights, by weighted fair queueing.

Every document (and every further copy of it) gets a place in its source's shuffled queue and a virtual finish time: the
source's tokens up to and with it, divided by the source's weight. All queues are merged by virtual finish time and cut at
the total budget, so sources are drawn in proportion to their weights, and where one runs dry the others take its place.
Running totals are two-staged (totals of hash or time buckets first, rows within a bucket after), so neither a dominating
source nor the global order ever passes through one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import broadcast_bounded, cut_lineage

#: Byte-level BPE ranks of a public tokenizer, and its published pattern.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKET_ROWS = 20_000
_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a ranks file; loaded once per process."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def count_tokens(documents: DataFrame, doc_id: str, source: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc, source, tokens of every document; NULL and empty texts have none. The whole text is counted."""
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in (x.as_py() for x in batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc", "source", "tokens"])

    return documents.select(F.col(doc_id).alias("doc"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc {kind}, source string, tokens long")


@dataclass(frozen=True)
class Mixture:
    """chosen: doc, source, copy, tokens, finish (virtual finish time). report: one row per target source."""

    chosen: DataFrame
    report: DataFrame


def finish_line(queues: list[tuple[float, int, int]], budget: float) -> float:
    """Virtual time at which queues of (weight, tokens, repeats) have given budget tokens together, or all run dry."""
    ends = sorted({tokens * repeats / weight for weight, tokens, repeats in queues})
    given = lambda v: sum(min(w * v, t * r) for w, t, r in queues)
    low = 0.0
    for end in ends:
        if given(end) >= budget:
            slope = sum(w for w, t, r in queues if t * r / w > low)
            return low + (budget - given(low)) / slope
        low = end
    return low


def mix_sources(
    documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", share: str = "target_share", repeats: str = "max_repeats",
    budget: int | None = None, tokenizer: str = TOKENIZER, seed: int = 7,
) -> Mixture:
    """Choose documents, with repeats, so that each source gives its share of budget tokens (default: the tokens of all documents).

    No document is used more than its source's repeats; its n-th copy comes only after the source's whole (n-1)-th round.
    The result never exceeds the budget. report: source, target_share, max_repeats, available_tokens (all documents, each
    used max_repeats times), target_tokens, chosen_tokens, chosen_rows, actual_share, and reachable: the queue, with all its
    repeats, does not run dry before the virtual time at which every source would have given its share.
    Shares are taken relative to their sum; targets without source or positive share are left out, a NULL or negative number
    of repeats counts as 1 or 0, of contradicting rows of a source the greater share holds. Documents of no target source,
    without source, or with NULL or empty text are never chosen, though their tokens count for the default budget. Repeated
    documents are separate documents. Without documents nothing is chosen and every source is reported.
    """
    spark = documents.sparkSession
    sized = cut_lineage(count_tokens(documents, doc_id, source, text, tokenizer))
    goals = targets.select(F.col(source).cast("string").alias("source"), F.col(share).cast("double").alias("share"), F.greatest(F.coalesce(F.col(repeats).cast("int"), F.lit(1)), F.lit(0)).alias("repeats"))
    goals = goals.where("source is not null and share > 0 and share < double('inf')").groupBy("source").agg(F.max(F.struct("share", "repeats")).alias("g")).select("source", "g.share", "g.repeats")
    stock = sized.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    plan = goals.join(stock, "source", "left").fillna(0, ["tokens", "rows"]).collect()  # one row per target source
    whole = sum(r.share for r in plan)
    if budget is None:
        budget = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    queues = [(r.share / whole, r.tokens, r.repeats) for r in plan if r.tokens and r.repeats]
    line = finish_line(queues, budget) if queues else 0.0
    rows = []
    for r in plan:
        weight = r.share / whole
        rounds = min(r.repeats, int(line * weight // r.tokens) + 1) if r.tokens else 0
        rows.append((r.source, weight, r.repeats, r.tokens, r.rows, rounds, max(1, r.rows // BUCKET_ROWS)))
    lanes = spark.createDataFrame(rows, "source string, weight double, repeats int, stock long, rows long, rounds int, buckets int")

    queue = (
        sized.where("tokens > 0").join(broadcast_bounded(lanes.where("rounds > 0"), 100_000), "source")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rounds"))))
        .withColumn("draw", F.xxhash64("doc", "copy", F.lit(seed))).withColumn("bucket", F.pmod("draw", "buckets"))
    )
    per_bucket = queue.groupBy("source", "copy", "bucket").agg(F.sum("tokens").alias("bucket_tokens"))
    earlier = W.partitionBy("source").orderBy("copy", "bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.select("source", "copy", "bucket", F.coalesce(F.sum("bucket_tokens").over(earlier), F.lit(0)).alias("before"))
    within = W.partitionBy("source", "copy", "bucket").orderBy("draw", "doc").rowsBetween(W.unboundedPreceding, W.currentRow)
    timed = (
        queue.withColumn("inner", F.sum("tokens").over(within)).join(offsets, ["source", "copy", "bucket"])
        .select("doc", "source", "copy", "tokens", "draw", ((F.col("before") + F.col("inner")) / F.col("weight")).alias("finish"))
        .where(F.col("finish") <= F.lit(line * (1 + 1e-9) + 1))
    )
    # The global order: ranges of virtual time, their running totals, and the running total within the range.
    ranges = max(1, sum(r[5] * r[6] for r in rows))
    timed = timed.withColumn("slice", F.least(F.lit(ranges - 1), F.floor(F.col("finish") * ranges / F.lit(max(line, 1.0)))).cast("int"))
    per_slice = timed.groupBy("slice").agg(F.sum("tokens").alias("slice_tokens"))
    so_far = per_slice.select("slice", F.coalesce(F.sum("slice_tokens").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = W.partitionBy("slice").orderBy("finish", "draw", "doc").rowsBetween(W.unboundedPreceding, W.currentRow)
    chosen = (
        timed.withColumn("inner", F.sum("tokens").over(order)).join(so_far, "slice").where(F.col("before") + F.col("inner") <= budget).select("doc", "source", "copy", "tokens", "finish")
    )
    taken = chosen.groupBy("source").agg(F.sum("tokens").alias("chosen_tokens"), F.count(F.lit(1)).alias("chosen_rows"))
    total = taken.agg(F.sum("chosen_tokens").alias("total"))
    # With weights that add up to 1, every source has given its share at the virtual time that equals the budget.
    early = timed.where(F.col("finish") < F.lit(float(budget))).groupBy("source").agg(F.count(F.lit(1)).alias("early_rows"))
    report = (
        lanes.join(taken, "source", "left").join(early, "source", "left").crossJoin(F.broadcast(total)).select(
            "source", F.col("weight").alias("target_share"), F.col("repeats").alias("max_repeats"), (F.col("stock") * F.col("repeats")).alias("available_tokens"), (F.col("weight") * budget).alias("target_tokens"),
            F.coalesce("chosen_tokens", F.lit(0)).alias("chosen_tokens"), F.coalesce("chosen_rows", F.lit(0)).alias("chosen_rows"), F.coalesce(F.expr("try_divide(chosen_tokens, total)"), F.lit(0.0)).alias("actual_share"),
            (F.coalesce("early_rows", F.lit(0)) < F.col("rows") * F.col("repeats")).alias("reachable"),
        )
    )
    return Mixture(chosen, report)


def in_order(mixture: Mixture, partitions: int | None = None) -> DataFrame:
    """The chosen documents range-sorted by virtual finish time, ready to be written."""
    shaped = mixture.chosen.repartitionByRange(partitions, "finish") if partitions else mixture.chosen.repartitionByRange("finish")
    return shaped.sortWithinPartitions("finish", "doc")
