"""Forests and boosted trees on spark.ml, with the log target and the regime blend.

A fit takes the rows that it is given; ``per_series`` gives it one series at a time. Split candidates are binned, so results resemble other forest
implementations but never equal them. Predictions stay columns of their rows.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from freshet.session import shared_folder

_INPUTS = "_inputs"


@dataclass(frozen=True)
class ForestSpec:
    trees: int = 600
    depth: int = 8
    leaf: int = 5


# Sizes of the published model set.
DAILY_FOREST = ForestSpec(600, 8, 5)
WEIGHTED_FOREST = ForestSpec(600, 8, 6)
MONTHLY_FOREST = ForestSpec(1200, 8, 3)
REGIME_CLASSIFIER = ForestSpec(500, 7, 10)
REGIME_LOW = ForestSpec(500, 8, 6)
REGIME_HIGH = ForestSpec(700, 9, 4)
REGIME_MIN_ROWS = 80

#: memory for the histograms of the tree nodes that are split in one pass
NODE_MEMORY_MB = 1024


@dataclass(frozen=True)
class BoostSpec:
    rounds: int = 800
    depth: int = 6
    rate: float = 0.05
    subsample: float = 0.8
    columns: float = 0.8


# Sizes of the published boosted models.
DAILY_BOOST = BoostSpec(800, 6)
MONTHLY_BOOST = BoostSpec(1200, 8)


def with_inputs(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=_INPUTS, handleInvalid="error").transform(df)


def training_table(train: DataFrame, features: list[str], rows_per_task: int = 50_000) -> DataFrame:
    """``train`` with assembled inputs in as many partitions as its rows need.

    A model table has one row per date and series; spread over the partitions of its joins, each of the many passes of
    a tree fit would cost more for its tasks than for its rows.
    """
    return with_inputs(train.coalesce(max(1, train.count() // rows_per_task)), features)


def fit_forest(
    train: DataFrame, features: list[str], label: str, spec: ForestSpec, weight: str | None = None, seed: int = 0
):
    """Regression forest; ``weight`` names a row-weight column."""
    forest = RandomForestRegressor(
        featuresCol=_INPUTS,
        labelCol=label,
        predictionCol="_prediction",
        numTrees=spec.trees,
        maxDepth=spec.depth,
        minInstancesPerNode=spec.leaf,
        featureSubsetStrategy="all",
        maxMemoryInMB=NODE_MEMORY_MB,
        seed=seed,
    )
    if weight:
        forest = forest.setWeightCol(weight)
    return forest.fit(training_table(train, features))


def fit_boosted(train: DataFrame, features: list[str], label: str, spec: BoostSpec, seed: int = 0):
    boosted = GBTRegressor(
        featuresCol=_INPUTS,
        labelCol=label,
        predictionCol="_prediction",
        maxIter=spec.rounds,
        maxDepth=spec.depth,
        stepSize=spec.rate,
        subsamplingRate=spec.subsample,
        featureSubsetStrategy=str(spec.columns),
        maxMemoryInMB=NODE_MEMORY_MB,
        seed=seed,
    )
    return boosted.fit(training_table(train, features))


def predict(df: DataFrame, model, features: list[str], name: str = "y_pred", log_target: bool = True) -> DataFrame:
    """Add the prediction on the original scale."""
    raw = F.expm1("_prediction") if log_target else F.col("_prediction")
    scored = model.transform(with_inputs(df, features))
    return scored.withColumn(name, raw).select(*df.columns, name)


@dataclass(frozen=True)
class RegimeBlend:
    classifier: PipelineModel
    low: PipelineModel
    high: PipelineModel


def fit_regime_blend(
    train: DataFrame,
    features: list[str],
    label: str,
    high: str,
    weight: str,
    classifier_spec: ForestSpec = REGIME_CLASSIFIER,
    low_spec: ForestSpec = REGIME_LOW,
    high_spec: ForestSpec = REGIME_HIGH,
    min_rows: int = REGIME_MIN_ROWS,
    seed: int = 0,
) -> RegimeBlend | None:
    """A classifier for the high regime and one forest per regime, or None when a regime has too few rows.

    ``high`` names a 0/1 column. Weights act on the classifier and on the high forest.
    """
    n = train.agg(F.count_if(F.col(high) == 1).alias("high"), F.count_if(F.col(high) == 0).alias("low")).first()
    if min(n["high"], n["low"]) < min_rows:
        return None
    classifier = RandomForestClassifier(
        featuresCol=_INPUTS,
        labelCol=high,
        probabilityCol="_probability",
        predictionCol="_class",
        rawPredictionCol="_votes",
        weightCol=weight,
        numTrees=classifier_spec.trees,
        maxDepth=classifier_spec.depth,
        minInstancesPerNode=classifier_spec.leaf,
        maxMemoryInMB=NODE_MEMORY_MB,
        seed=seed,
    ).fit(training_table(train, features))
    return RegimeBlend(
        classifier,
        fit_forest(train.where(F.col(high) == 0), features, label, low_spec, seed=seed),
        fit_forest(train.where(F.col(high) == 1), features, label, high_spec, weight=weight, seed=seed),
    )


def predict_regime_blend(
    df: DataFrame, blend: RegimeBlend, features: list[str], name: str = "y_pred", parts: bool = False
) -> DataFrame:
    """Regime forecasts on the original scale, mixed by the probability of the high regime.

    With ``parts`` the forecasts of the two regimes stay as ``{name}_low`` and ``{name}_high``.
    """
    odds = blend.classifier.transform(with_inputs(df, features))
    odds = odds.withColumn("_p_high", vector_to_array("_probability")[1]).select(*df.columns, "_p_high")
    both = predict(predict(odds, blend.low, features, "_low"), blend.high, features, "_high")
    mixed = F.col("_p_high") * F.col("_high") + (1 - F.col("_p_high")) * F.col("_low")
    shown = [F.col(f"_{p}").alias(f"{name}_{p}") for p in ("low", "high")] if parts else []
    return both.withColumn(name, mixed).select(*df.columns, name, *shown)


Predictor = Callable[[DataFrame], DataFrame]


def per_series(
    table: DataFrame, fits: dict[str, Callable[[DataFrame], Predictor | None]], series: str = "series_id", workers: int = 4
) -> DataFrame:
    """``table`` with one column for each of ``fits``, every model fitted on the training rows of one series.

    A fit takes the rows with split 'train' of a series and returns what adds its column, or None where they are too few;
    that column is null then, with a warning. Fits of different series and models do not wait for each other: ``workers``
    of them run at once, each as jobs of its own in a scheduler pool of its name, and Spark shares the executors among
    them. Each series' predictions are written to the shared folder, so the result's plan does not grow with the series.
    """
    spark = table.sparkSession
    names = [r[0] for r in table.select(series).distinct().collect()]
    folder = f"{shared_folder(spark).rstrip('/')}/freshet-series-{uuid.uuid4().hex}"
    own = {s: table.where(F.col(series).eqNullSafe(s)) for s in names}

    def fitted(job: tuple) -> Predictor | None:
        s, name = job
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        train = own[s].where("split = 'train'")
        found = None if train.isEmpty() else fits[name](train)
        if found is None:
            warnings.warn(f"too few training rows of series {s!r} for {name}", stacklevel=2)
        return found

    def written(job: tuple) -> None:
        at, s = job
        rows = own[s]
        for name in fits:
            predictor = models[s, name]
            rows = rows.withColumn(name, F.lit(None).cast("double")) if predictor is None else predictor(rows)
        rows.select(*table.columns, *fits).write.parquet(f"{folder}/{at}")

    jobs = [(s, name) for s in names for name in fits]
    with ThreadPoolExecutor(workers) as pool:
        models = dict(zip(jobs, pool.map(inheritable_thread_target(spark)(fitted), jobs), strict=True))
        list(pool.map(inheritable_thread_target(spark)(written), enumerate(names)))
    schema = StructType([*table.schema.fields, *[StructField(n, DoubleType()) for n in fits]])
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/*")
