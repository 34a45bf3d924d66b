"""Filling missing cells of a mixed-frequency panel from rows of the same load, entity, series or time.

Three Chow-Liu trees, one after the other: entity from load and column, name from the series (entity and column) once the
entity is known, and the value's bin from the bins of the series' neighbours in time and of other records of the same cell.
Numeric posteriors are decoded to the median of the bin in the series. Every filled cell is marked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.model import finite
from tidemark.operators.dependency_tree import fit_tree, posterior_modes
from tidemark.session import cut_lineage, small

# What stands for "missing" in text cells, after trimming and lower case.
MISSING_TEXT = ("", "-", "--", "?", "??", "???", ".", "n/a", "na", "n.a.", "#n/a", "nan", "none", "null", "nil", "<na>", "missing", "unknown", "undefined", "tbd", "not available")
#: Names a reader of headerless files makes up.
MISSING_PATTERN = r"(?i)^(unnamed(:.*)?|feature_?\??|column_?\??|var_?\??)$"
#: Fences of a group of numbers: this many quartile distances beyond the quartiles.
FAR = 3
#: Distance from the median, in quartile distances, from which a number needs no second occurrence to be a fill value.
BEYOND = 100
#: Share of the series (and at least two of them) in which a far number must recur to be a fill value.
RECURS = 1e-3
BINS = 24


def real_text(cell: Column, valid: str | None = None) -> Column:
    """The trimmed cell, NULL if it has no real content; valid: pattern that every real cell matches."""
    text = F.regexp_replace(cell, r"^[\s ​]+|[\s ​]+$", "")
    real = ~F.lower(text).isin(*MISSING_TEXT) & ~text.rlike(MISSING_PATTERN)
    if valid is not None:
        real &= text.rlike(valid)
    return F.when(real, text)


def fill_panel(
    panel: DataFrame, row_id: str = "obs_id", load: str = "load_id", column: str = "column_no", entity: str = "entity_id", name: str = "name", freq: str = "freq", date: str = "obs_date", value: str = "value",
    valid_entity: str | None = "^N[A-Z]{4}$", valid_name: str | None = None,
) -> DataFrame:
    """row_id, entity, name, value with every missing cell filled, and entity_filled, name_filled, value_filled, confidence.

    A cell is missing if NULL, NaN, infinite, blank, a placeholder, or a fill number; see real_text and without_fill_codes.
    Duplicates are filled each for themselves. A field without any real cell in the whole table stays NULL, marked as
    filled. Rows lacking load, column, frequency or date are filled from what evidence they have. Ties go to the greater
    value. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    base = panel.select(
        F.col(row_id).alias("row_id"), F.col(load).cast("string").alias("load"), F.col(column).cast("string").alias("col_no"), F.col(freq).cast("string").alias("freq"), F.col(date).cast("date").alias("date"),
        real_text(F.col(entity).cast("string"), valid_entity).alias("entity"), real_text(F.col(name).cast("string"), valid_name).alias("name"), finite(value).alias("raw"),
    ).withColumn("slot", F.concat_ws("|", "load", "col_no"))
    base = cut_lineage(base.withColumn("entity_filled", F.col("entity").isNull()).withColumn("name_filled", F.col("name").isNull()))

    known = _fill(base, ("load", "slot", "freq", "entity", "name"), "entity")
    known = known.withColumn("series", F.concat_ws("|", "entity", "col_no"))
    known = cut_lineage(_fill(known, ("load", "slot", "series", "freq", "name"), "name"))
    known = without_fill_codes(known).withColumn("value_filled", F.col("v").isNull())
    return _fill_values(known).select("row_id", "entity", "name", "value", "entity_filled", "name_filled", "value_filled", "confidence")


def _fill(rows: DataFrame, fields: tuple[str, ...], target: str) -> DataFrame:
    tree = fit_tree(rows, fields)
    others = [f for f in fields if f != target]
    modes = small(posterior_modes(tree, rows, target).select(*[F.col(f).alias(f"e_{f}") for f in others], F.col("mode").alias("the_mode")))
    same = F.lit(True)
    for f in others:
        same &= F.col(f).eqNullSafe(F.col(f"e_{f}"))
    filled = rows.where(F.col(target).isNull()).join(modes, same, "left").withColumn(target, F.col("the_mode")).select(*rows.columns)
    return rows.where(F.col(target).isNotNull()).unionByName(filled)


def _outside(v: Column, quartiles: Column, times: float) -> Column:
    """v lies times quartile distances beyond the quartiles; that distance counts as a hundredth of the median at least."""
    width = F.greatest(quartiles[2] - quartiles[0], F.abs(quartiles[1]) / 100)
    return (v < quartiles[0] - times * width) | (v > quartiles[2] + times * width)


def _far_off(v: Column, quartiles: Column, times: float) -> Column:
    return F.abs(v - quartiles[1]) > times * F.greatest(quartiles[2] - quartiles[0], F.abs(quartiles[1]) / 100)


def without_fill_codes(rows: DataFrame) -> DataFrame:
    """Adds v: the number raw, NULL where it is a fill value. Needs series, name and raw.

    Which numbers stand for "missing" is read off the data. A number beyond the range of its name (FAR quartile distances
    beyond the quartiles) that recurs in at least two series and RECURS of all series is a code, for measurements far off
    don't agree to the last digit; a cell with a code is missing if it lies beyond the range of its own series as well, taken
    without codes, or if the series holds nothing else. A number BEYOND quartile distances off both the name's and the
    series' median is a fill value even if it occurs once. Quartiles bear up to a quarter of fill values.
    """
    quartiles = F.percentile_approx("raw", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000)
    known = rows.where("raw is not null")
    of_name = small(known.groupBy("name").agg(quartiles.alias("q_name")))
    ranged = known.join(of_name.withColumnRenamed("name", "n_"), F.col("name").eqNullSafe(F.col("n_"))).drop("n_")
    series = known.select("series").distinct().count()
    codes = small(
        ranged.where(_outside(F.col("raw"), F.col("q_name"), FAR)).groupBy("raw").agg(F.count_distinct("series").alias("in_series"))
        .where(F.col("in_series") >= max(2, RECURS * series)).select(F.col("raw").alias("code"))
    )
    marked = ranged.join(codes, F.col("raw") == F.col("code"), "left")
    of_series = marked.where("code is null").groupBy("series").agg(quartiles.alias("q"))
    judged = marked.join(of_series, "series", "left")
    coded = F.col("code").isNotNull() & _outside(F.col("raw"), F.col("q_name"), FAR) & F.coalesce(_outside(F.col("raw"), F.col("q"), FAR), F.lit(True))
    lone = _far_off(F.col("raw"), F.col("q_name"), BEYOND) & F.coalesce(_far_off(F.col("raw"), F.col("q"), BEYOND), F.lit(True))
    judged = judged.withColumn("v", F.when(~(coded | lone), F.col("raw"))).drop("q", "q_name", "code")
    return judged.unionByName(rows.where("raw is null").withColumn("v", F.lit(None).cast("double")))


def _fill_values(rows: DataFrame) -> DataFrame:
    rows = cut_lineage(rows)
    # One value per cell of a series; a series has at most one cell per day, so the windows below are bounded by the calendar.
    cells = rows.groupBy("series", "date").agg(F.avg("v").alias("cell"))
    w = W.partitionBy("series")
    past = w.orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    future = w.orderBy(F.col("date").desc()).rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.last("cell", ignorenulls=True).over(past)).withColumn("after", F.last("cell", ignorenulls=True).over(future))
    cuts = rows.where("v is not null").groupBy("series").agg(F.percentile_approx("v", F.array(*[F.lit(k / BINS) for k in range(1, BINS)]), 2000).alias("cuts"))

    def binned(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.size(F.filter("cuts", lambda x: x < F.col(c))).cast("string"))

    keyed = (
        rows.join(cells, ["series", "date"], "left").join(cuts, "series", "left")
        .withColumn("bin", binned("v")).withColumn("same", F.when(F.col("v").isNull(), binned("cell"))).withColumn("before_bin", binned("before")).withColumn("after_bin", binned("after"))
        .withColumn("month", F.month("date").cast("string")).drop("cuts")
    )
    # Where the value is there, the other records of its cell are the cell without it; equal to it for exact copies.
    keyed = cut_lineage(keyed.withColumn("same", F.coalesce("same", F.when(F.col("v").isNotNull(), F.col("bin")))))
    fields = ("bin", "same", "before_bin", "after_bin", "month")
    tree = fit_tree(keyed, fields)
    modes = small(posterior_modes(tree, keyed, "bin"))
    medians = keyed.where("v is not null").groupBy("series", "bin").agg(F.percentile_approx("v", 0.5, 2000).alias("bin_median"))
    series_median = keyed.where("v is not null").groupBy("series").agg(F.percentile_approx("v", 0.5, 2000).alias("series_median"))
    name_median = keyed.where("v is not null").groupBy("name").agg(F.percentile_approx("v", 0.5, 2000).alias("name_median"))
    whole_median = keyed.where("v is not null").agg(F.percentile_approx("v", 0.5, 2000).alias("whole_median"))
    others = fields[1:]
    match = F.lit(True)
    renamed = modes.select(*[F.col(f).alias(f"e_{f}") for f in others], "mode", "confidence")
    for f in others:
        match &= F.col(f).eqNullSafe(F.col(f"e_{f}"))
    gaps = keyed.where("v is null").join(renamed, match, "left").drop("bin").withColumnRenamed("mode", "bin")
    filled = (
        gaps.join(medians, ["series", "bin"], "left").join(series_median, "series", "left").join(name_median, "name", "left").crossJoin(F.broadcast(whole_median))
        .withColumn("value", F.coalesce("cell", "bin_median", "series_median", "name_median", "whole_median"))
    )
    keep = ["row_id", "entity", "name", "value", "entity_filled", "name_filled", "value_filled", "confidence"]
    return keyed.where("v is not null").withColumn("value", F.col("v")).withColumn("confidence", F.lit(None).cast("double")).select(*keep).unionByName(filled.select(*keep))
