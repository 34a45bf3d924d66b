"""Implausible measurements: spikes, stuck values and impossible readings, against each source's own behaviour.

Spikes: Hampel filter, that is the distance from the rolling median in units of the source's median absolute deviation.
Stuck values: runs of one value much longer than the longest run the source's own repetition rate explains.
Impossible: outside physical bounds.

Two passes, neither of which needs a source to fit a task. Readings are numbered in time order and cut into blocks of
block_rows, with half a window more on either side, so that every rolling median is the one of the uncut series. The first
pass reduces each block to what adds up over blocks: counts of deviations by fine bins, counts of runs by value, and the
stretches of one value that are long or reach a border. From these come the whole source's median absolute deviation and
repetition rate, and the runs across borders. The second pass judges every reading against them. No result depends on how
the readings are cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.kernels.hampel import BINS_PER_OCTAVE, ZERO_BIN, deviation_bins, deviations, run_lengths, smallest_step
from tidemark.model import epoch_us, usable
from tidemark.operators.blocks import numbered
from tidemark.session import cut_lineage, small, written

#: Median and mean absolute deviation of a normal variable, times these, are its standard deviation.
MAD_TO_SIGMA, MEAN_TO_SIGMA = 1.4826, 1.2533
#: A value that makes up more than this share of a source is its resting value; its runs don't count for the repetition rate.
RESTING_SHARE = 0.3
PRIOR_RUNS = 10
#: A run of more than this share of a source's readings is no fault but the source's normal state.
NORMAL_STATE = 0.9
SUMMARY = (
    "source string, block long, n long, step double, bins array<long>, counts array<long>, vals array<double>, often array<long>, runs array<long>, runs2 array<long>, runs3 array<long>,"
    " stretches array<struct<t:long,v:double,len:long,from_left:boolean>>"
)


@dataclass(frozen=True)
class Bounds:
    """Physical bounds; a value equal to an open end is impossible, as is any infinite value."""

    low: float | None = None
    low_open: bool = False
    high: float | None = None

    def violated(self, v: Column) -> Column:
        bad = F.abs(v) == float("inf")
        if self.low is not None:
            bad |= (v <= self.low) if self.low_open else (v < self.low)
        if self.high is not None:
            bad |= v > self.high
        return bad


def _ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by time and value; times, values, and which rows are the block's own."""
    t, v = table["t"].to_numpy(), table["v"].to_numpy()
    order = np.lexsort((v, t))
    return order, t[order], v[order], table["inner"].to_numpy(zero_copy_only=False)[order]


def _summary(log_scale: bool, half: int, least_run: int) -> Callable[[pa.Table], pa.Table]:
    """First pass over a block."""

    def summarise(table: pa.Table) -> pa.Table:
        _, t, v, inner = _ordered(table)
        x = np.log(v) if log_scale else v
        own = np.flatnonzero(inner)
        first, last = own[0], own[-1] + 1
        bins, counts = deviation_bins(deviations(x, half)[first:last])
        step = smallest_step(x[max(0, first - 1) : last])
        # Runs are counted where they start; the margins tell whether they go on from the left and reach two and three values.
        same = np.r_[False, v[1:] == v[:-1], False, False, False]
        begins = own[~same[own]]
        values, often = np.unique(v[first:last], return_counts=True)
        of = np.searchsorted(values, v[begins])
        total = lambda chosen: np.bincount(of, weights=chosen, minlength=len(values)).astype(np.int64)
        two = same[begins + 1]
        runs, runs2, runs3 = total(np.ones(len(begins))), total(two), total(two & same[begins + 2])
        at, length = run_lengths(v[first:last])
        at += first
        kept = (length >= least_run) | (at == first) | (at + length == last)
        stretches = [{"t": int(t[a]), "v": float(v[a]), "len": int(n), "from_left": bool(same[a])} for a, n in zip(at[kept], length[kept], strict=True)]
        listed = lambda a, kind: pa.array([a.tolist()], pa.list_(kind))
        return pa.table(
            {
                "source": table["source"][:1], "block": table["block"][:1], "n": pa.array([len(own)], pa.int64()), "step": pa.array([step], pa.float64()),
                "bins": listed(bins, pa.int64()), "counts": listed(counts, pa.int64()), "vals": listed(values, pa.float64()), "often": listed(often, pa.int64()),
                "runs": listed(runs, pa.int64()), "runs2": listed(runs2, pa.int64()), "runs3": listed(runs3, pa.int64()),
                "stretches": pa.array([stretches], pa.list_(pa.struct([("t", pa.int64()), ("v", pa.float64()), ("len", pa.int64()), ("from_left", pa.bool_())]))),
            }
        )

    return summarise


def _verdicts(log_scale: bool, half: int, spike_z: float, upper_only: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Second pass over a block: rows that stand out from the source's scale, and rows of runs found too long."""

    def judge(table: pa.Table, known: pa.Table) -> pa.Table:
        order, t, v, inner = _ordered(table) if len(table) else (np.array([], int), *(np.array([]),) * 2, np.array([], bool))
        scale = known["scale"][0].as_py() if len(known) else 0.0
        dev = deviations(np.log(v) if log_scale else v, half)
        side = dev if upper_only else np.abs(dev)
        spikes = np.flatnonzero(inner & (side > spike_z * scale) & (side > 0))
        picked, score, kinds = [spikes], [side[spikes] / scale if scale > 0 else np.full(len(spikes), np.inf)], ["spike"] * len(spikes)
        for run in (known["stuck"][0].as_py() or []) if len(known) else []:
            # A stretch is known by its first reading; the reading that opens the whole run is the good one.
            at = int(np.searchsorted(t, run["t"]))
            while v[at] != run["v"]:
                at += 1
            rows = np.arange(at + (not run["from_left"]), at + run["len"])
            picked.append(rows)
            score.append(np.full(len(rows), float(run["total"])))
            kinds += ["stuck"] * len(rows)
        rows = np.concatenate(picked).astype(int)
        taken = table.take(pa.array(order[rows]))
        return pa.table(
            {
                "source": taken["source"], "t": taken["t"], "v": taken["v"], "copies": taken["copies"], "row_id": taken["row_id"],
                "kind": pa.array(kinds, pa.string()), "score": pa.array(np.concatenate(score), pa.float64()),
            }
        )

    return judge


def implausible_readings(
    readings: DataFrame, source: str, ts: str, value: str, row_id: str, bounds: Bounds, *, log_scale: bool = False, upper_only: bool = False,
    half_window: int = 7, spike_z: float = 12.5, least_scale: float = 0.0, calm_share: float = 0.98, run_ratio: float = 2.3, least_run: int = 6, block_rows: int = 8192,
) -> DataFrame:
    """Flagged rows: row_id, source, kind ('impossible', 'spike' or 'stuck'), score.

    score: for spikes the distance from the rolling median in robust scales, for stuck values the run's length. Copies of a
    reading (same source, time and value) are judged once and flagged together. NULL and NaN are never flagged, break no
    run and are no neighbours; rows without source or time are only held against the bounds. An empty table, a source with
    one reading and a constant source give no flags; ties in time are ordered by value. A row may appear under two kinds.
    The scale is the median absolute deviation (1.4826 times the median size of all deviations of the source), but not below
    0.3 of the smallest step between readings, nor below least_scale. Where more than half of the deviations are 0 it is
    taken from the mean of the smallest calm_share of them, to be lowered where sources are short and several readings may
    be wrong. log_scale needs bounds that exclude values <= 0. block_rows only decides how the work is cut up.
    """
    if log_scale and not (bounds.low is not None and (bounds.low > 0 or bounds.low == 0 and bounds.low_open)):
        raise ValueError("log_scale needs positive values")
    kind = readings.schema[row_id].dataType.simpleString()
    rows = readings.select(F.col(source).cast("string").alias("source"), epoch_us(ts).alias("t"), usable(value).alias("v"), F.col(row_id).alias("row_id")).where("v is not null")
    impossible = rows.where(bounds.violated(F.col("v"))).select("row_id", "source", F.lit("impossible").alias("kind"), F.lit(None).cast("double").alias("score"))
    possible = rows.where(~bounds.violated(F.col("v"))).where("source is not null and t is not null").withColumn("v", F.col("v") + 0.0)
    distinct = possible.groupBy("source", "t", "v").agg(F.count(F.lit(1)).alias("copies"), F.max("row_id").alias("row_id"))
    blocks = written(_blocks(distinct, possible, half_window, block_rows))

    parts = cut_lineage(blocks.groupBy("source", "block").applyInArrow(_summary(log_scale, half_window, least_run), SUMMARY))
    known = parts.select("source", "block").join(_scales(parts, calm_share, least_scale), "source").join(_stuck(parts, run_ratio, least_run), ["source", "block"], "left")
    found = blocks.groupBy("source", "block").cogroup(known.groupBy("source", "block")).applyInArrow(
        _verdicts(log_scale, half_window, spike_z, upper_only), f"source string, t long, v double, copies long, row_id {kind}, kind string, score double"
    )
    # Only readings that came more than once have to be looked up again for the other rows' ids.
    found = cut_lineage(found)
    once = found.where("copies = 1").select("row_id", "source", "kind", "score")
    often = small(found.where("copies > 1").select("source", "t", "v", "kind", "score"))
    copies = possible.join(often, ["source", "t", "v"]).select("row_id", "source", "kind", "score")
    return impossible.unionByName(once).unionByName(copies)


def _blocks(distinct: DataFrame, possible: DataFrame, half: int, block_rows: int) -> DataFrame:
    """source, block, t, v, copies, row_id, inner: the readings of each block and, with inner false, half a window around it."""
    placed = numbered(distinct, possible, "source", "t", ("v",), block_rows)
    # Sources within a block's size have one; a block that would only hold a margin lies beyond the source's end.
    near = F.expr(f"sequence(greatest(0, (number - {half}) div {block_rows}), least((number + {half}) div {block_rows}, (coalesce(total, 1) - 1) div {block_rows}))")
    cut = placed.withColumn("block", F.explode(near)).withColumn("inner", F.col("block") == F.expr(f"number div {block_rows}"))
    return cut.select("source", "block", "t", "v", "copies", "row_id", "inner")


def _scales(parts: DataFrame, calm_share: float, least_scale: float) -> DataFrame:
    """source, scale: from the counts of deviations by bin, of which a source has a bounded number whatever its length."""
    bins = parts.select("source", F.explode(F.arrays_zip("bins", "counts")).alias("b")).groupBy("source", F.col("b.bins").alias("bin")).agg(F.sum("b.counts").alias("c"))
    so_far = W.partitionBy("source").orderBy("bin")
    placed = bins.withColumn("upto", F.sum("c").over(so_far)).withColumn("n", F.sum("c").over(W.partitionBy("source")))
    size = F.when(F.col("bin") == ZERO_BIN, 0.0).otherwise(F.pow(F.lit(2.0), (F.col("bin") + 0.5) / BINS_PER_OCTAVE))
    z = NormalDist().inv_cdf(0.5 + calm_share / 2)
    widen = MEAN_TO_SIGMA * (calm_share / (1 - math.exp(-z * z / 2)) if calm_share < 0.95 else 1.0)
    calm = F.col("upto") - F.col("c") < calm_share * F.col("n")
    middle = F.min(F.when(F.col("upto") * 2 >= F.col("n"), size))
    measured = placed.groupBy("source").agg((MAD_TO_SIGMA * middle).alias("mad"), (widen * F.sum(F.when(calm, F.col("c") * size)) / F.sum(F.when(calm, F.col("c")))).alias("calm"))
    step = parts.groupBy("source").agg(F.min("step").alias("step"))
    floor = F.greatest(F.lit(least_scale), F.when(F.col("step") < float("inf"), 0.3 * F.col("step")).otherwise(0.0))
    return measured.join(step, "source").select("source", F.greatest(floor, F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("calm"))).alias("scale"))


def _stuck(parts: DataFrame, run_ratio: float, least_run: int) -> DataFrame:
    """source, block, stuck: the block's stretches (t, v, len, from_left, total of the run) of runs that are too long for the source.

    How likely a value repeats is the greater of the shares of runs that reach two and, of those, three values; the second
    share is drawn to the first by PRIOR_RUNS runs. Counting runs and not values, a few stuck runs hardly move it. A value the
    source often has outside the run may also repeat as often.
    """
    each = F.explode(F.arrays_zip("vals", "often", "runs", "runs2", "runs3")).alias("x")
    values = parts.select("source", each).groupBy("source", F.col("x.vals").alias("v")).agg(*[F.sum(f"x.{c}").alias(c) for c in ("often", "runs", "runs2", "runs3")])
    n = parts.groupBy("source").agg(F.sum("n").alias("n"))
    moving = lambda c: F.sum(F.when(F.col("often") <= RESTING_SHARE * F.col("n"), F.col(c)).otherwise(0)).alias(c)
    rates = values.join(n, "source").groupBy("source", "n").agg(moving("runs"), moving("runs2"), moving("runs3"))
    first = F.col("runs2") / F.greatest(F.lit(1), "runs")
    rates = rates.select("source", "n", F.greatest(F.lit(0.01), first, (F.col("runs3") + PRIOR_RUNS * first) / (F.col("runs2") + PRIOR_RUNS)).alias("p"))

    stretches = parts.select("source", "block", F.explode("stretches").alias("s")).select("source", "block", "s.*")
    in_time = W.partitionBy("source").orderBy("block", "t")
    # A stretch that goes on from the left belongs to the stretch before it, which then reached its block's right border.
    numbered = stretches.withColumn("run", F.sum(F.when(F.col("from_left"), 0).otherwise(1)).over(in_time))
    runs = numbered.withColumn("total", F.sum("len").over(W.partitionBy("source", "run"))).where(F.col("total") >= least_run)
    judged = runs.join(rates, "source").join(values.select("source", "v", "often"), ["source", "v"])
    outside = (F.col("often") - F.col("total")) / F.greatest(F.lit(1), F.col("n") - F.col("total"))
    judged = judged.withColumn("p", F.least(F.lit(0.98), F.greatest("p", outside)))
    longest = F.log(F.greatest(F.lit(2.0), F.col("n") * (1 - F.col("p")))) / F.log(1 / F.col("p"))
    too_long = judged.where((F.col("total") >= run_ratio * longest) & (F.col("total") <= NORMAL_STATE * F.col("n")))
    return too_long.groupBy("source", "block").agg(F.collect_list(F.struct("t", "v", "len", "from_left", "total")).alias("stuck"))
