"""Runs of identical or nearly identical consecutive events, collapsed to one event each.

Boundary interval lookup: the events of an entity are cut into blocks of a stated number of events; a block's run starts are
gathered into a sorted array, every event is assigned to its run by binary search in that array, and the runs are
aggregated. Runs inside a block are done then; only those at a block's borders are joined with what follows, two a block, so
an entity that holds most events is many tasks. Spellings are reduced to a key once per distinct label of a batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.spelling import keys_of
from tidemark.model import epoch_us
from tidemark.operators.blocks import numbered
from tidemark.session import cut_lineage

DAY_US = 86_400_000_000
PIECE = "array<struct<run:int,label:string,start:bigint,stop:bigint,n:bigint>>"


def event_runs(
    events: DataFrame, entity: str, ts: str, label: str, tie_breaks: tuple[str, ...] = (), labels: tuple[str, ...] = (), fillers: tuple[str, ...] = (), block_events: int = 4096
) -> DataFrame:
    """One row per maximal run: entity, label, start_us, end_us, n_events (different times), duration_us.

    Events with NULL or blank label, and rows without entity or time, are passed over and break no run. Several rows of one
    time count once; if they disagree, the last by tie_breaks (then the greater label) holds. Gaps in time break no run. An
    empty table gives no rows. Spellings are nearly identical if they stand for the same of labels, or, of other labels, if they
    differ in case, accents, punctuation, spaces and fillers only. block_events decides how the work is cut up, not the result.
    """
    rows = events.select(F.col(entity).cast("string").alias("entity"), epoch_us(ts).alias("t"), F.col(label).cast("string").alias("spelling"), *[F.col(c).alias(f"tie{i}") for i, c in enumerate(tie_breaks)])
    rows = rows.where("entity is not null and t is not null and trim(spelling) <> ''")
    # One row per entity, time and spelling before any Python; then one per entity and time.
    ties = [F.max(f"tie{i}").alias(f"tie{i}") for i in range(len(tie_breaks))]
    once = rows.groupBy("entity", "t", "spelling").agg(F.count(F.lit(1)).alias("copies"), *ties)
    keyed = once.withColumn("label", keys_of(F.col("spelling"), tuple(labels), tuple(fillers))).where("label is not null")
    at = keyed.groupBy("entity", "t").agg(F.max_by("label", F.struct(*[f"tie{i}" for i in range(len(tie_breaks))], "label")).alias("label"))
    placed = numbered(at, rows, "entity", "t", (), block_events).withColumn("block", F.expr(f"number div {block_events}"))
    blocks = (
        placed.groupBy("entity", "block").agg(F.array_sort(F.collect_list(F.struct("t", "label"))).alias("seen"))
        .select("entity", "block", F.transform("seen", lambda x: x["t"]).alias("times"), F.transform("seen", lambda x: x["label"]).alias("names"))
    )

    @F.pandas_udf(PIECE)
    def pieces(times: pd.Series, names: pd.Series) -> pd.Series:
        out = []
        for t, name in zip(times, names, strict=True):
            t, name = np.asarray(t, dtype=np.int64), np.asarray(name, dtype=object)
            starts = t[np.r_[True, name[1:] != name[:-1]]]
            run = np.searchsorted(starts, t, side="right") - 1
            n = np.bincount(run, minlength=len(starts))
            ends = t[np.cumsum(n) - 1]
            label_of = name[np.cumsum(n) - n]
            out.append([{"run": i, "label": label_of[i], "start": int(starts[i]), "stop": int(ends[i]), "n": int(n[i])} for i in range(len(starts))])
        return pd.Series(out)

    runs = blocks.select("entity", "block", pieces("times", "names").alias("p"))
    parts = cut_lineage(runs.select("entity", "block", F.size("p").alias("runs"), F.explode("p").alias("x")).select("entity", "block", "runs", "x.*"))
    border = (F.col("run") == 0) | (F.col("run") == F.col("runs") - 1)
    # Only a block's first run can go on from the block before.
    order = W.partitionBy("entity").orderBy("start")
    opens = F.when((F.col("run") > 0) | F.lag("label").over(order).isNull() | (F.lag("label").over(order) != F.col("label")), 1).otherwise(0)
    joined = parts.where(border).withColumn("opens", opens).withColumn("run_no", F.sum("opens").over(order))
    across = joined.groupBy("entity", "run_no").agg(F.first("label").alias("label"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n"))
    columns = ["entity", "label", F.col("start").alias("start_us"), F.col("stop").alias("end_us"), F.col("n").alias("n_events"), (F.col("stop") - F.col("start")).alias("duration_us")]
    return parts.where(~border).select(*columns).unionByName(across.select(*columns))
