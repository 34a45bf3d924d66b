"""Irregular readings onto a regular grid, by validity intervals.

A reading holds from its time to the next reading's. These intervals tile each subscription window; cut at grid lines they
give each slot's time-weighted average, the fraction of the slot covered by a value and the number of readings in it.
A window is handled in blocks of BLOCK_SLOTS slots, each opened by an entry that carries in the value still valid, so the
readings of one source spread over many tasks and all steps after the first exchange keep its partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.model import epoch_us, usable

BLOCK_SLOTS = 1024


def regular_grid(
    readings: DataFrame, windows: DataFrame, entity: str = "symbol", ts: str = "ts", value: str = "close", tie_breaks: tuple[str, ...] = ("arrived_at", "reading_id"),
    window_id: str = "window_id", start: str = "start_ts", end: str = "end_ts", step_seconds: str = "grid_seconds",
) -> DataFrame:
    """One row per window and slot: window, entity, slot, slot_epoch, n_readings, average, coverage, held, status.

    average: time-weighted over the part of the slot that has a value; coverage: that part as a fraction of the slot;
    held: the value valid at the slot's end, carried from earlier slots where the slot has no reading;
    status: 'observed' (a reading in the slot), 'filled' (a carried value), 'missing' (before the window's first reading).
    Of several readings at one time the last by tie_breaks holds. NULL and NaN are no readings; an infinite value is a
    reading and makes the averages of its slots infinite. Readings in no window, and windows without entity, positive step or length, give nothing.
    """
    grid = windows.select(
        F.col(window_id).alias("window"), F.col(entity).alias("who"), epoch_us(start).alias("s"), epoch_us(end).alias("e"), (F.col(step_seconds).cast("long") * 1_000_000).alias("g")
    ).where("who is not null and s < e and g > 0").withColumn("slots", F.ceil((F.col("e") - F.col("s")) / F.col("g")).cast("long"))
    ties = [F.col(c).alias(f"tie{i}") for i, c in enumerate(tie_breaks)]
    seen = readings.select(F.col(entity).alias("who"), epoch_us(ts).alias("t"), usable(value).alias("v"), *ties).where("v is not null and t is not null")
    order = [f"tie{i}" for i in range(len(ties))]
    placed = (
        seen.join(grid, "who").where("t >= s and t < e")
        .withColumn("block", F.expr(f"((t - s) div g) div {BLOCK_SLOTS}"))
        .select("window", "who", "s", "e", "g", "block", "t", "v", *order)
    )
    last = placed.groupBy("window", "block").agg(F.max_by("v", F.struct("t", *order)).alias("last_v"))
    before = W.partitionBy("window").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    opening = (
        grid.withColumn("block", F.explode(F.expr(f"sequence(0L, (slots - 1) div {BLOCK_SLOTS})")))
        .join(last, ["window", "block"], "left")
        .select("window", "who", "s", "e", "g", "block", (F.col("s") + F.col("block") * BLOCK_SLOTS * F.col("g")).alias("t"), F.last("last_v", ignorenulls=True).over(before).alias("v"))
    )
    rows = placed.withColumn("real", F.lit(1)).unionByName(opening.withColumn("real", F.lit(0)), allowMissingColumns=True)
    nxt = F.lead("t").over(W.partitionBy("window", "block").orderBy("t", "real", *order))
    stop = F.coalesce(nxt, F.least("e", F.col("s") + (F.col("block") + 1) * BLOCK_SLOTS * F.col("g")))
    cells = (
        rows.withColumn("stop", stop)
        .withColumn("first_slot", F.expr("(t - s) div g"))
        .withColumn("slot", F.explode(F.expr("sequence(first_slot, (greatest(stop - 1, t) - s) div g)")))
        .withColumn("from", F.greatest("t", F.col("s") + F.col("slot") * F.col("g")))
        .withColumn("held_us", F.greatest(F.lit(0), F.least("stop", F.col("s") + (F.col("slot") + 1) * F.col("g")) - F.col("from")))
    )
    return (
        cells.groupBy("window", "block", "slot")
        .agg(
            F.first("who").alias("entity"), F.first("s").alias("s"), F.first("e").alias("e"), F.first("g").alias("g"),
            F.sum(F.when(F.col("slot") == F.col("first_slot"), F.col("real")).otherwise(0)).alias("n_readings"),
            F.sum(F.when(F.col("held_us") > 0, F.col("v") * F.col("held_us"))).alias("area"),
            F.sum(F.when(F.col("v").isNotNull(), F.col("held_us"))).alias("covered"),
            F.max_by("v", F.when(F.col("v").isNotNull(), F.struct("t", "real", *order))).alias("held"),
        )
        .select(
            "window", "entity", "slot", F.expr("(s + slot * g) div 1000000").alias("slot_epoch"), "n_readings",
            F.expr("try_divide(area, covered)").alias("average"),
            (F.coalesce("covered", F.lit(0)) / (F.least("e", F.col("s") + (F.col("slot") + 1) * F.col("g")) - (F.col("s") + F.col("slot") * F.col("g")))).alias("coverage"),
            "held", F.when(F.col("n_readings") > 0, "observed").when(F.col("held").isNotNull(), "filled").otherwise("missing").alias("status"),
        )
    )
