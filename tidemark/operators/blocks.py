"""Rows of a key numbered in order, so that a key of any size can be cut into blocks of equal numbers of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import small


def numbered(rows: DataFrame, counted: DataFrame, key: str, at: str, ties: tuple[str, ...], block_rows: int) -> DataFrame:
    """Adds number (0-based place within the key, by at and ties) and total; 0 and NULL for keys of at most block_rows rows.

    counted: rows with the same keys and times, from which sizes are estimated (rows themselves, or what they were made of).
    The place is that of the row's bucket of time, of about half a block however unevenly the buckets fill, plus the place
    within the bucket. Keys within block_rows need neither.
    """
    large = small(
        counted.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.min(at).alias("t0"), F.max(at).alias("t1")).where(F.col("rows") > block_rows)
        .select(key, "t0", F.greatest(F.lit(1), F.expr(f"cast((t1 - t0) * {block_rows / 2} / rows as long)")).alias("width"))
    )
    marked = rows.join(large, key, "left")
    whole = marked.where("t0 is null").withColumn("number", F.lit(0).cast("long")).withColumn("total", F.lit(None).cast("long"))
    bucketed = marked.where("t0 is not null").withColumn("bucket", F.expr(f"({at} - t0) div width"))
    sizes = bucketed.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("size"))
    before = W.partitionBy(key).orderBy("bucket")
    starts = sizes.select(key, "bucket", (F.sum("size").over(before) - F.col("size")).alias("first"), F.sum("size").over(W.partitionBy(key)).alias("total"))
    place = F.row_number().over(W.partitionBy(key, "bucket").orderBy(at, *ties)) - 1
    ordered = bucketed.withColumn("place", place).join(starts, [key, "bucket"]).withColumn("number", (F.col("first") + F.col("place")).cast("long"))
    columns = [*rows.columns, "number", "total"]
    return whole.select(*columns).unionByName(ordered.select(*columns))
