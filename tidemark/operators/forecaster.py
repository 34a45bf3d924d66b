"""Boosted trees over a panel of entities, on quarterly features."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.align import wide


def fit_panel(features: DataFrame, names: list[str], target: str, rounds: int = 100, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Predictions (entity, quarter, actual, prediction) and importances (feature, importance).

    features: entity, quarter, name, value in long form; names: the features used, a stated list; missing ones are filled
    by their mean, columns without any value by 0. The entity is a category. Quarters without the target are predicted too.
    """
    keyed = features.withColumn("key", F.struct("entity", "quarter"))
    matrix = wide(keyed, "key", "name", "value", [*names, target]).select("key.*", *names, F.col(target).alias("actual")).cache()
    empty = matrix.agg(*[F.count(n).alias(n) for n in names]).first().asDict()
    matrix = matrix.fillna(0.0, [n for n in names if not empty[n]]) if any(not v for v in empty.values()) else matrix
    filled = [f"{n}_filled" for n in names]
    stages = [
        StringIndexer(inputCol="entity", outputCol="entity_code", handleInvalid="keep"), Imputer(inputCols=names, outputCols=filled, strategy="mean"),
        VectorAssembler(inputCols=["entity_code", *filled], outputCol="x"),
    ]
    prepared = Pipeline(stages=stages).fit(matrix).transform(matrix)
    entities = max(32, matrix.select("entity").distinct().count() + 2)
    model = GBTRegressor(featuresCol="x", labelCol="actual", maxIter=rounds, maxDepth=4, maxBins=entities, seed=seed).fit(prepared.where("actual is not null"))
    weights = model.featureImportances.toArray()
    importances = features.sparkSession.createDataFrame([(n, float(w)) for n, w in zip(["entity", *names], weights, strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return model.transform(prepared).select("entity", "quarter", "actual", "prediction"), importances
