"""Evaluation texts leaking into a corpus: every document holding a passage of an item, with the item.

Prefix-filtered set join over shingles of five words. An item's windows need only be looked up by their rarest shingles
(rarity counted over the whole corpus), so a shingle commoner than all others within reach of it is left out. The reach is such
that every match of the asked length and tolerance leaves two shingles intact within it, of which one is kept. Documents and items are joined on these prefix
shingles, bounded by length and position, and verified exactly by alignment over item-sized windows.

Items are a stated query set. They are taken in blocks of items_per_block, each against all documents; within a block the
words of the items are small and go to every task, and a document is reduced to the surroundings of its hits in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.words import words
from tidemark.session import cut_lineage

SHINGLE = 5
#: The words of a block's items are broadcast if there are at most that many (4 bytes each).
BROADCAST_WORDS = 5_000_000
#: Odd multipliers of the shingle hash; a collision only costs a verification.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingle_codes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every shingle without an unknown word (id 0)."""
    n = len(ids) - SHINGLE + 1
    if n <= 0:
        return np.array([], int), np.array([], np.int64)
    known = ids > 0
    good = known[:n].copy()
    for k in range(1, SHINGLE):
        good &= known[k : k + n]
    at = np.flatnonzero(good)
    code = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        code = (code ^ (ids[at + k].astype(np.uint64) * FACTORS[k])) * FACTORS[(k + 1) % SHINGLE]
    return at, code.view(np.int64)


def aligned(text: np.ndarray, item: np.ndarray, shifts: np.ndarray, span: int, rate: int) -> int:
    """Longest passage found: item words covered, at least span of them, from a matching word to a matching one, with at
    most one word in rate altered (replaced, left out or put in); 0 if there is none. shifts: text minus item position of
    the shared shingles; the alignment may drift from them by one altered word in rate of the item."""
    drift = max(2, len(item) // rate)
    groups: list[list[int]] = []
    for s in np.unique(shifts):
        if groups and s - groups[-1][1] <= drift:
            groups[-1][1] = int(s)
        else:
            groups.append([int(s), int(s)])
    n, m = len(item), len(text)
    for low, high in groups:
        low, high = low - drift, high + drift
        width = high - low + 1
        at = np.arange(n)[None, :] + np.arange(low, high + 1)[:, None]
        inside = (at >= 0) & (at < m)
        match = inside & (text[np.clip(at, 0, m - 1)] == item[None, :]) & (item[None, :] > 0)
        if match.any(axis=0).sum() < span - span // rate:
            continue
        if straight(match, span, rate):
            return span
        # score = matches - (rate - 1) * (replaced + left out) - rate * put in; at least 0 means few enough are altered.
        best = np.full((width, span + 1), -np.inf)
        for i in range(n):
            for d in range(1, width):
                np.maximum(best[d], best[d - 1] - rate, out=best[d])
            gone = best - (rate - 1)
            hit = match[:, i]
            best[:, 0] = np.where(hit, np.maximum(best[:, 0], 0), best[:, 0])
            moved = np.where(hit[:, None], best + 1, gone)
            fresh = np.full_like(best, -np.inf)
            fresh[:, 1:] = moved[:, :-1]
            fresh[:, span] = np.maximum(fresh[:, span], moved[:, span])
            if (fresh[hit, span] >= 0).any():
                return span
            left_out = np.full_like(best, -np.inf)
            left_out[:-1, 1:] = gone[1:, :-1]
            left_out[:-1, span] = np.maximum(left_out[:-1, span], gone[1:, span])
            best = np.maximum(fresh, left_out)
            best[:, 0] = -np.inf
    return 0


def straight(match: np.ndarray, span: int, rate: int) -> bool:
    """Whether some shift alone holds a passage: from a match to a match, span words or more, one in rate replaced at most."""
    n = match.shape[1]
    if n < span:
        return False
    gain = np.where(match, 1, 1 - rate).cumsum(axis=1)
    before = np.concatenate([np.zeros((len(match), 1), gain.dtype), gain[:, :-1]], axis=1)
    start = np.minimum.accumulate(np.where(match, before, n * rate), axis=1)[:, : n - span + 1]
    return bool((match[:, span - 1 :] & (gain[:, span - 1 :] >= start)).any())


def prefix_reach(span: int, rate: int) -> int | None:
    """Within how many places every passage the rule allows has two intact shingles; None if one may have fewer than two.

    k altered words cut a passage of n item words into k + 1 runs, which hold c >= n - k - (SHINGLE - 1) * (k + 1) shingles at
    n - SHINGLE + 1 places, so two of them lie within (n - SHINGLE) / (c - 1). The shortest passage for each k is the worst.
    For growing k the bound falls to rate / (rate - SHINGLE), so few k need a look.
    """
    reach = 1
    for k in range(100):
        n = max(span, rate * k)
        c = n - k - (SHINGLE - 1) * (k + 1)
        if c < 2:
            return None
        reach = max(reach, (n - SHINGLE) // (c - 1))
    return reach


def leaked_items(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", span: int = 18, rate: int = 7, items_per_block: int = 20_000
) -> DataFrame:
    """doc, item: documents holding at least span successive words of the item in order, one in rate altered at most.

    Case, punctuation, mark-up, escapes, line and cell breaks and invisible characters don't count (words.words). NULL and
    empty texts hold nothing; items of fewer words than span can't leak; NULL ids are passed over. Repeated documents and
    items give their pairs once per id. Empty tables give no rows. The prefix filter loses no candidate (prefix_reach).
    """
    listed = items.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null")
    blocks = max(1, math.ceil(listed.count() / items_per_block))
    found = None
    for k in range(blocks):
        part = listed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        pairs = _block(documents, part, doc_id, text, span, rate)
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct() if blocks > 1 else found


def _block(documents: DataFrame, items: DataFrame, doc_id: str, text: str, span: int, rate: int) -> DataFrame:
    spark = documents.sparkSession
    kind_doc, kind_item = documents.schema[doc_id].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    rows = [(r.item, words(r.text)) for r in items.distinct().collect()]  # at most items_per_block
    vocabulary: dict[str, int] = {}
    coded = [(i, np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws], np.int32)) for i, ws in rows if len(ws) >= span]
    margin = max((len(ids) for _, ids in coded), default=0) + 16
    entries = [(i, int(p), int(c)) for i, ids in coded for p, c in zip(*shingle_codes(ids), strict=True)]
    wanted = np.unique(np.array([c for _, _, c in entries], np.int64))
    shingles = spark.createDataFrame(entries, f"item {kind_item}, place int, code long") if entries else spark.createDataFrame([], f"item {kind_item}, place int, code long")
    item_words = spark.createDataFrame([(i, ids.tolist()) for i, ids in coded], f"item {kind_item}, item_ids array<int>")
    if sum(len(ids) for _, ids in coded) <= BROADCAST_WORDS:
        item_words = F.broadcast(item_words)

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            docs, parts, size = [], [], 0
            out: list[tuple] = []
            for row in range(batch.num_rows):
                docs.append((row, size))
                ids = [get(w, 0) for w in words(texts[row].as_py())]
                ids += [0] * SHINGLE
                parts.append(ids)
                size += len(ids)
                if size > 400_000 or row == batch.num_rows - 1:
                    _cut(docs, parts, names, out)
                    docs, parts, size = [], [], 0
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], batch.schema.field(0).type), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.list_(pa.int32())), pa.array([o[3] for o in out], pa.list_(pa.int32())), pa.array([o[4] for o in out], pa.list_(pa.int64()))],
                    names=["doc", "part", "ids", "at", "codes"],
                )

    def _cut(docs: list, parts: list, names: pa.Array, out: list) -> None:
        """Adds the surroundings of the hits of some documents."""
        ids = np.fromiter((x for p in parts for x in p), np.int32)
        at, code = shingle_codes(ids)
        if not len(at) or not len(wanted):
            return
        spot = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
        hit = wanted[spot] == code
        at, code = at[hit], code[hit]
        begins = np.array([b for _, b in docs])
        of = np.searchsorted(begins, at, side="right") - 1
        for d in np.unique(of):
            mine = of == d
            a, c = at[mine], code[mine]
            first, last = begins[d], begins[d] + len(parts[d])
            groups = np.split(np.arange(len(a)), np.flatnonzero(np.diff(a) > 2 * margin) + 1)
            for k, g in enumerate(groups):
                low, high = max(first, a[g[0]] - margin), min(last, a[g[-1]] + margin)
                out.append((names[docs[d][0]].as_py(), k, ids[low:high].tolist(), (a[g] - low).tolist(), c[g].tolist()))

    near = cut_lineage(
        documents.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text")).where("doc is not null and text <> ''").mapInArrow(surroundings, f"doc {kind_doc}, part int, ids array<int>, at array<int>, codes array<long>")
    )
    # A document id may come more than once, so a part is known by its place in the written copy.
    near = near.withColumn("spot", F.monotonically_increasing_id())
    hits = near.select("doc", "spot", F.explode(F.arrays_zip("at", "codes")).alias("h")).select("doc", "spot", F.col("h.at").alias("at"), F.col("h.codes").alias("code"))
    frequency = hits.select("doc", "code").distinct().groupBy("code").agg(F.count(F.lit(1)).alias("docs"))
    # Shingles in the order of rarity: one commoner than all others within reach is no prefix shingle; two such lie further apart.
    ranked = shingles.join(frequency, "code")
    reach = prefix_reach(span, rate)
    if reach is not None:
        around = W.partitionBy("item").orderBy("place")
        ranked = ranked.withColumn("rank", F.struct("docs", "code"))
        ranked = ranked.withColumn("others", F.greatest(F.max("rank").over(around.rangeBetween(-reach, -1)), F.max("rank").over(around.rangeBetween(1, reach))))
        ranked = ranked.where(F.col("others").isNull() | (F.col("rank") <= F.col("others")))
    prefix = ranked.select("item", "place", "code")
    candidates = hits.join(prefix, "code").groupBy("spot", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("shifts"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (2, 3, 4)]
            good = [aligned(np.asarray(t), np.asarray(i), np.asarray(s), span, rate) > 0 for t, i, s in zip(*columns, strict=True)]
            yield batch.select(["doc", "item"]).filter(pa.array(good, pa.bool_()))

    # The pairs are few bytes but much work, so they are spread over a stated number of tasks, pair by pair. (A filter would be
    # moved before that exchange.)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    pairs = candidates.join(near.select("spot", "doc", "ids"), "spot").join(item_words, "item").repartition(tasks, "spot", "item")
    return pairs.select("doc", "item", "ids", "item_ids", "shifts").mapInArrow(verified, f"doc {kind_doc}, item {kind_item}").distinct()
