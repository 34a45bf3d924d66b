"""The package's functions under SQL names, and the tables of a folder as views: the text interface."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tidemark.functions.special import chi2_tail
from tidemark.operators.fracdiff import ffd_weights
from tidemark.operators.text import in_context


def register_functions(spark: SparkSession) -> None:
    """chi2_tail(x, df), keyword_passages(text, keyword, around), and the table function ffd_weights(d, threshold)."""

    @F.pandas_udf(ArrayType(StringType()))
    def keyword_passages(text: pd.Series, keyword: pd.Series, around: pd.Series) -> pd.Series:
        return pd.Series([in_context(t, [k], int(a)) if t is not None and k else [] for t, k, a in zip(text, keyword, around, strict=True)])

    @F.udtf(returnType="place int, weight double")
    class Weights:
        def eval(self, d: float, threshold: float):
            yield from enumerate(ffd_weights(float(d), float(threshold)))

    spark.udf.register("chi2_tail", chi2_tail)
    spark.udf.register("keyword_passages", keyword_passages)
    spark.udtf.register("ffd_weights", Weights)


def register_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """A temporary view per Parquet table of the folder; their names."""
    names = sorted(p.name.removesuffix(".parquet") for p in Path(sf_dir).glob("*.parquet"))
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return names
