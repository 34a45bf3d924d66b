"""Rolling totals over trailing periods, kept as versioned daily state.

The state is a ledger (one accepted amount per entity and day) and the totals (one row per entity, period length and
calendar day). A batch of arrivals changes some days of the ledger; a changed day adds its difference to the running total
when it enters a period and takes it off when it expires, so yesterday's total, today's arrival and the expiring day's
amount give today's total, and only the days a change can reach are written again, under the new version.

A running total never spans more than one block of BLOCK_DAYS days: differences still alive at a block's start are carried
in as an opening entry. One entity is thus many independent tasks however many rows it has, and repeated bars of a day are
reduced to one before anything is shuffled by block. Blocks no change reaches are neither read nor written: RollingStore
keeps the state as files by block, adds the rewritten blocks of each batch and reads only the blocks a batch reaches.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.model import epoch_day, finite
from tidemark.session import cut_lineage, written

BLOCK_DAYS = 512
MONEY = "decimal(38,6)"


LEDGER = f"entity string, day int, amount {MONEY}, seen_at timestamp, bar long"
SPANS = "entity string, first_day int, last_day int"
TOTALS = f"entity string, block int, win_days int, day int, total {MONEY}, n long, version int"


@dataclass(frozen=True)
class RollingState:
    """ledger: entity, day, amount, seen_at, bar. spans: entity, first_day, last_day.

    totals: entity, block, win_days, day, total, n, version. accepted and rewritten: the rows of ledger and totals that the
    last batch wrote. first: nothing has arrived yet.
    """

    ledger: DataFrame
    spans: DataFrame
    totals: DataFrame
    accepted: DataFrame
    rewritten: DataFrame
    first: bool = False


def empty_state(spark: SparkSession) -> RollingState:
    """The state before any arrival."""
    ledger, spans, totals = (spark.createDataFrame([], kind) for kind in (LEDGER, SPANS, TOTALS))
    return RollingState(ledger, spans, totals, ledger, totals, True)


def daily_amounts(bars: DataFrame, entity: str, ts: str, amount: str, seen_at: str, bar_id: str, latest: bool = True) -> DataFrame:
    """One accepted bar per entity and day: the last (or first) seen, then the highest (lowest) id.

    Rows without entity, time or a finite amount (NULL, NaN, infinite) are no bars. Amounts are kept as decimals of six
    places, so totals don't depend on the order of adding; one of more than 22 digits before the point is an error.
    """
    reports = daily_reports(bars, entity, ts, amount, seen_at, bar_id)
    return amounts_of(reports, "last" if latest else "first")


def daily_reports(bars: DataFrame, entity: str, ts: str, amount: str, seen_at: str, bar_id: str) -> DataFrame:
    """entity, day, first, last: the day's bar seen first and the one seen last; see daily_amounts."""
    exact = F.expr(f"try_cast(({_text(amount)}) AS decimal(28,6))")
    too_large = F.raise_error(F.lit("an amount has more than 22 digits before the point")).cast("decimal(28,6)")
    rows = bars.select(
        F.col(entity).cast("string").alias("entity"),
        epoch_day(ts).alias("day"),
        F.when(finite(amount).isNotNull(), F.coalesce(exact, too_large)).cast(MONEY).alias("amount"),
        F.col(seen_at).cast("timestamp").alias("seen_at"),
        F.col(bar_id).cast("long").alias("bar"),
    ).where("entity is not null and day is not null and amount is not null")
    bar = F.struct("seen_at", "bar", "amount")
    return rows.groupBy("entity", "day").agg(F.min(bar).alias("first"), F.max(bar).alias("last"))


def amounts_of(reports: DataFrame, which: str) -> DataFrame:
    """A batch for advance: the first or last bars of daily_reports."""
    return reports.select("entity", "day", f"{which}.amount", f"{which}.seen_at", f"{which}.bar")


def _text(amount: str) -> str:
    name = f"`{amount}`"
    return f"CASE WHEN isnan(CAST({name} AS double)) OR abs(CAST({name} AS double)) = double('inf') THEN NULL ELSE {name} END"


def _block(day: Column | str) -> Column:
    return F.floor((F.col(day) if isinstance(day, str) else day) / BLOCK_DAYS).cast("int")


def advance(state: RollingState, arrivals: DataFrame, version: int, periods: tuple[int, ...] = (7, 30)) -> RollingState:
    """The next version of the state after a batch of daily amounts (one row per entity and day, see daily_amounts).

    A later arrival for a day already in the ledger is a correction if it was seen later (or at the same time under a higher
    id). Only blocks that a change or a new calendar day reaches are worked out again; the others are passed through. Within
    a block, totals of days no change reaches keep their version. An empty batch leaves the state as it is.
    """
    if max(periods) > BLOCK_DAYS or min(periods) < 1:
        raise ValueError(f"periods must lie in 1..{BLOCK_DAYS}")
    accepted, grown, changed = _changes(state, arrivals, max(periods))
    reached = changed.join(grown.select("entity", "last_day"), "entity").withColumn(
        "block", F.explode(F.sequence(_block("start"), F.greatest(_block("start"), _block(F.least(F.col("last_day"), F.col("day") + max(periods) - 1)))))
    )
    spine = _touched(reached, grown).join(grown.select("entity", "first_day", "last_day"), "entity").select(
        "entity", "block", F.explode(F.sequence(F.greatest("first_day", F.col("block") * BLOCK_DAYS), F.least("last_day", (F.col("block") + 1) * BLOCK_DAYS - 1))).alias("day")
    )

    # A change enters on its day, or at the block's start if it is still alive there, and leaves each period at its end.
    enters = F.greatest("start", F.col("block") * BLOCK_DAYS)
    signs = lambda of: [of(p).alias(f"s{p}") for p in periods]
    entry = F.struct(enters.alias("at"), *signs(lambda p: F.when(F.col("day") + p > enters, 1).otherwise(0)))
    exits = [F.struct((F.col("day") + q).alias("at"), *signs(lambda p, q=q: F.lit(-1 if p == q else 0))) for q in periods]
    within = lambda e: (e["at"] > enters) & (e["at"] < (F.col("block") + 1) * BLOCK_DAYS)
    moves = reached.select("entity", "block", "d_total", "d_n", F.explode(F.array(entry, *[F.when(within(e), e) for e in exits])).alias("e")).where("e is not null")
    zero = F.lit(0).cast(MONEY)
    signed = lambda p, c, none: F.when(F.col(f"e.s{p}") == 1, F.col(c)).when(F.col(f"e.s{p}") == -1, -F.col(c)).otherwise(none)
    columns = [c for p in periods for c in (f"t{p}", f"n{p}")]
    moves = moves.select(
        "entity", "block", F.col("e.at").alias("day"), F.lit(False).alias("kept"),
        *[c for p in periods for c in (signed(p, "d_total", zero).cast(MONEY).alias(f"t{p}"), signed(p, "d_n", F.lit(0)).alias(f"n{p}"))],
    )
    days = spine.select("*", F.lit(True).alias("kept"), *[c for p in periods for c in (zero.alias(f"t{p}"), F.lit(0).alias(f"n{p}"))])
    running = W.partitionBy("entity", "block").orderBy("day").rangeBetween(W.unboundedPreceding, W.currentRow)
    summed = moves.unionByName(days).select("entity", "block", "day", "kept", *[F.sum(c).over(running).alias(c) for c in columns]).where("kept")
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("win_days"), F.col(f"t{p}").cast(MONEY).alias("add_total"), F.col(f"n{p}").cast("long").alias("add_n")) for p in periods]))
    moved = summed.select("entity", "block", "day", each.alias("x")).select("entity", "block", "day", "x.*")

    if state.first:
        rewritten = moved.select("entity", "block", "win_days", "day", F.col("add_total").alias("total"), F.col("add_n").alias("n"), F.lit(version).alias("version"))
        return RollingState(accepted, grown.select("entity", "first_day", "last_day"), rewritten, accepted, rewritten)
    touched = _touched(reached, grown)
    before = state.totals.join(touched, ["entity", "block"], "left_semi").select("entity", "block", "win_days", "day", F.col("total").alias("t0"), F.col("n").alias("n0"), F.col("version").alias("v0"))
    rewritten = moved.join(before, ["entity", "block", "win_days", "day"], "left").select(
        "entity", "block", "win_days", "day", (F.coalesce("t0", zero) + F.col("add_total")).cast(MONEY).alias("total"), (F.coalesce("n0", F.lit(0)) + F.col("add_n")).cast("long").alias("n"),
        F.when(F.col("v0").isNotNull() & (F.col("add_total") == 0) & (F.col("add_n") == 0), F.col("v0")).otherwise(version).cast("int").alias("version"),
    )
    ledger = state.ledger.join(accepted.select("entity", "day"), ["entity", "day"], "left_anti").unionByName(accepted)
    spans = state.spans.join(grown.select("entity"), "entity", "left_anti").unionByName(grown.select("entity", "first_day", "last_day"))
    return RollingState(ledger, spans, state.totals.join(touched, ["entity", "block"], "left_anti").unionByName(rewritten), accepted, rewritten)


def _changes(state: RollingState, arrivals: DataFrame, longest: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted bars; spans of their entities before and after; differences: entity, day, start, d_total, d_n."""
    zero, bar = F.lit(0).cast(MONEY), F.struct("seen_at", "bar", "amount")
    new = arrivals.select("entity", "day", bar.alias("new"))
    if state.first:
        both = new.withColumn("old", F.lit(None).cast(new.schema["new"].dataType))
    else:
        both = new.join(state.ledger.select("entity", "day", bar.alias("old")), ["entity", "day"], "left").where("old is null or new > old")
    accepted = both.select("entity", "day", "new.amount", "new.seen_at", "new.bar")
    grown = accepted.groupBy("entity").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    if state.first:
        grown = grown.withColumn("old_first", F.lit(None).cast("int")).withColumn("old_last", F.lit(None).cast("int"))
    else:
        known = state.spans.select("entity", F.col("first_day").alias("old_first"), F.col("last_day").alias("old_last"))
        grown = grown.join(known, "entity", "left").select("entity", F.least("first_day", "old_first").alias("first_day"), F.greatest("last_day", "old_last").alias("last_day"), "old_first", "old_last")
    changed = both.select(
        "entity", "day", F.col("day").alias("start"), (F.col("new.amount") - F.coalesce("old.amount", zero)).cast(MONEY).alias("d_total"), F.when(F.col("old").isNull(), 1).otherwise(0).alias("d_n")
    ).where("d_total <> 0 or d_n <> 0")
    if not state.first:
        # Days appended after the old last day still hold amounts of the old ledger.
        tail = state.ledger.join(grown.where("old_last < last_day").select("entity", "old_last"), "entity").where(F.col("day") > F.col("old_last") - longest)
        changed = changed.unionByName(tail.select("entity", "day", (F.col("old_last") + 1).alias("start"), F.col("amount").alias("d_total"), F.lit(1).alias("d_n")).where(F.col("start") < F.col("day") + longest))
    return accepted, grown, changed


def _touched(reached: DataFrame, grown: DataFrame) -> DataFrame:
    """entity, block: blocks that a change reaches or that hold a new calendar day."""
    before = F.struct(F.col("first_day").alias("a"), F.coalesce(F.col("old_first") - 1, "last_day").alias("b"))
    after = F.struct(F.coalesce(F.col("old_last") + 1, "first_day").alias("a"), F.col("last_day").alias("b"))
    fresh = grown.select("entity", F.explode(F.array(before, after)).alias("s")).where("s.a <= s.b").select("entity", F.explode(F.sequence(_block("s.a"), _block("s.b"))).alias("block"))
    return reached.select("entity", "block").unionByName(fresh).distinct()


class RollingStore:
    """The state in a folder that all executors share: ledger and totals by batch and block, spans by batch.

    A batch adds only the blocks it rewrites; of a block the newest batch's rows hold. A batch reads only the blocks it
    reaches, by partition pruning, so a correction of one day costs one or two blocks whatever the length of the history.
    """

    def __init__(self, spark: SparkSession, folder: str, periods: tuple[int, ...] = (7, 30)) -> None:
        self.spark, self.folder, self.periods = spark, folder.rstrip("/"), periods

    def batches(self) -> list[int]:
        """Numbers of the batches written, in order."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.folder}/spans")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        return sorted(int(f.getPath().getName().removeprefix("batch=")) for f in files.listStatus(path) if f.getPath().getName().startswith("batch="))

    def state(self, blocks: list[int] | None = None) -> RollingState:
        """The newest state; with blocks, only what lies in these blocks of days."""
        done = self.batches()
        if not done:
            return empty_state(self.spark)
        ledger = self.spark.read.parquet(f"{self.folder}/ledger").where(F.col("batch") <= done[-1])
        totals = self.spark.read.parquet(f"{self.folder}/totals").where(F.col("batch") <= done[-1])
        if blocks is not None:
            ledger, totals = ledger.where(F.col("block").isin(blocks)), totals.where(F.col("block").isin(blocks))
        bar = F.struct("amount", "seen_at", "bar")
        ledger = ledger.groupBy("entity", "day").agg(F.max_by(bar, "batch").alias("b")).select("entity", "day", "b.*")
        newest = totals.groupBy("entity", "block").agg(F.max("batch").alias("batch"))
        totals = totals.join(newest, ["entity", "block", "batch"]).select("entity", "block", "win_days", "day", "total", "n", "version")
        spans = self.spark.read.parquet(f"{self.folder}/spans/batch={done[-1]}")
        return RollingState(ledger, spans, totals, ledger, totals)

    def apply(self, arrivals: DataFrame) -> int:
        """Take in a batch of daily amounts; returns its number. spans is written last and makes the batch valid."""
        done = self.batches()
        batch = done[-1] + 1 if done else 1
        arrivals = cut_lineage(arrivals)
        state = self.state(self._reach(arrivals)) if done else empty_state(self.spark)
        after = advance(state, arrivals, batch, self.periods)
        after.accepted.withColumn("block", _block("day")).write.mode("overwrite").partitionBy("block").parquet(f"{self.folder}/ledger/batch={batch}")
        after.rewritten.write.mode("overwrite").partitionBy("block").parquet(f"{self.folder}/totals/batch={batch}")
        after.spans.write.mode("overwrite").parquet(f"{self.folder}/spans/batch={batch}")
        return batch

    def _reach(self, arrivals: DataFrame) -> list[int]:
        """Numbers of the blocks of days a batch can reach; their number is bounded by the calendar."""
        longest = max(self.periods)
        spans = self.state([]).spans.select("entity", "first_day", "last_day")
        known = arrivals.join(spans, "entity", "left")
        ranges = F.array(
            F.struct(F.col("day").alias("a"), (F.col("day") + longest).alias("b")),
            F.when(F.col("day") > F.col("last_day"), F.struct((F.col("last_day") - longest).alias("a"), F.col("day").alias("b"))),
            F.when(F.col("day") < F.col("first_day"), F.struct(F.col("day").alias("a"), F.col("first_day").alias("b"))),
        )
        blocks = known.select(F.explode(ranges).alias("r")).where("r is not null").select(F.explode(F.sequence(_block("r.a"), _block("r.b"))).alias("block"))
        return [r.block for r in blocks.distinct().collect()]


def rolling_totals(bars: DataFrame, entity: str = "symbol", ts: str = "ts", amount: str = "close", seen_at: str = "ingested_at", bar_id: str = "bar_id", periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Totals and averages for every entity and every calendar day from its first to its last usable bar.

    Columns: entity, win_days, day (days since 1970), total, n (days with a bar in the period), average (total over the days
    of the period, empty days counting as days), average_reported (over days with a bar, NULL where none), version.
    Version 1 is the state after the first report of each day, version 2 after the corrections that came later.
    An empty table gives no rows; nulls, NaN and infinite amounts are no bars; repeated rows count once.
    """
    reports = cut_lineage(daily_reports(bars, entity, ts, amount, seen_at, bar_id))
    one = advance(empty_state(bars.sparkSession), amounts_of(reports, "first"), 1, periods)
    one = replace(one, totals=written(one.totals))
    two = advance(one, amounts_of(reports.where("last > first"), "last"), 2, periods)
    return two.totals.select(
        "entity", "win_days", "day", "total", "n",
        (F.col("total").cast("double") / F.col("win_days")).alias("average"), F.expr("try_divide(cast(total as double), n)").alias("average_reported"), "version",
    )
