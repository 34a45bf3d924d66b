"""File sources: dated CSV files, several of them merged, JSON price arrays, text documents, and landed observations."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.series import parse_quarter
from tidemark.operators.align import aligned

ENCODINGS = ("utf-8", "utf-16", "latin-1", "cp1252")
TEXT_TYPES = (".txt", ".md")


def read_csv(spark: SparkSession, path: str, date_col: str | None = None, value_cols: list[str] | None = None, date_format: str | None = None) -> DataFrame:
    """ts (date) and the value columns as doubles; the first column is the date unless named. Quarter strings become quarter ends.

    Rows whose date can't be read are left out; values that are no numbers are NULL.
    """
    raw = spark.read.csv(path, header=True)
    date_col = date_col or raw.columns[0]
    names = value_cols or [c for c in raw.columns if c != date_col]
    d = F.col(f"`{date_col}`")
    ts = F.to_date(F.try_to_timestamp(d, F.lit(date_format))) if date_format else F.coalesce(parse_quarter(d), F.to_date(F.try_to_timestamp(d)))
    return raw.select(ts.alias("ts"), *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in names]).where("ts is not null")


def read_series(spark: SparkSession, files: dict[str, str], freq: str | None = None) -> DataFrame:
    """series_id, ts, value of several CSV files in long form; a file's only column takes the given name, others get it as prefix."""
    parts = []
    for name, path in files.items():
        wide = read_csv(spark, path)
        values = [c for c in wide.columns if c != "ts"]
        named = wide.toDF("ts", *[name if len(values) == 1 else f"{name}_{c}" for c in values])
        parts.append(named.unpivot(["ts"], [c for c in named.columns if c != "ts"], "series_id", "value").select("series_id", "ts", "value"))
    if not parts:
        raise ValueError("no files")
    long = reduce(DataFrame.unionByName, parts)
    return aligned(long, freq, "none") if freq else long


def merge_csv(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """ts and one column per series on the union of all dates, in date order: one pivot whatever the number of files."""
    long = read_series(spark, files)
    names = sorted(r.series_id for r in long.select("series_id").distinct().collect())  # as many as the files have columns
    return long.groupBy("ts").pivot("series_id", names).agg(F.first("value", ignorenulls=True)).orderBy("ts")


def price_arrays(landed: DataFrame, symbol: str, body: str, field: str = "prices") -> DataFrame:
    """series_id, ts, value from JSON bodies {"prices": [[milliseconds, price], ...]}; bodies that can't be read give no rows."""
    parsed = F.from_json(F.col(body), f"{field} array<array<double>>")[field]
    return landed.select(F.col(symbol).alias("series_id"), F.explode(parsed).alias("p")).where("size(p) = 2").select("series_id", F.timestamp_millis(F.col("p")[0].cast("long")).alias("ts"), F.col("p")[1].alias("value"))


def fear_and_greed(landed: DataFrame, body: str) -> DataFrame:
    """ts, value from JSON bodies {"data": [{"value": "40", "timestamp": "1600000000"}, ...]}, in time order."""
    parsed = F.from_json(F.col(body), "data array<struct<value:string,timestamp:string>>")["data"]
    rows = landed.select(F.explode(parsed).alias("d"))
    return rows.select(F.timestamp_seconds(F.expr("try_cast(d.timestamp as long)")).alias("ts"), F.expr("try_cast(d.value as double)").alias("value")).where("ts is not null").orderBy("ts")


def decode(content: Column) -> Column:
    """Bytes as text: with a byte-order mark UTF-16, else UTF-8 if valid, else Latin-1."""
    head = F.hex(F.substring(content, 1, 2))
    return F.when(head.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, filename, file_type, file_size, text of the .txt and .md files under a path. PDF and DOCX need readers not at hand."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md}").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("filename"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("file_type"), F.col("length").alias("file_size"), decode(F.col("content")).alias("text"))


def supported(path: str) -> bool:
    """Whether read_documents takes the file."""
    return Path(path).suffix.lower() in TEXT_TYPES


def close_column(columns: list[str]) -> str:
    """The first column whose name has 'close' in it, else the first: the price to take of a wide frame."""
    return next((c for c in columns if "close" in c.lower()), columns[0])


def target_column(columns: list[str], entity: str = "entity_id") -> str:
    """The column that looks like the target (gdp or target in its name, y, y_..., ..._y), else the last that is no entity."""
    plain = [c for c in columns if c != entity]
    looks = lambda c: "gdp" in c or "target" in c or c == "y" or c.startswith("y_") or c.endswith("_y")
    return next((c for c in plain if looks(c.lower())), plain[-1])
