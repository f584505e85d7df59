"""Boosted trees, random forests, a small neural network, and grid tuning, on Spark ML.

Defaults are the settings of the eligibility models; tests and queries pass fewer trees.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings of the tuned boosted model.
BOOST = {"maxDepth": 10, "maxIter": 1000, "minInstancesPerNode": 40, "stepSize": 0.0178, "minInfoGain": 5.62e-5}


def _pipeline(features: Sequence[str], learner, scale: bool = False) -> Pipeline:
    stages = [VectorAssembler(inputCols=list(features), outputCol="__raw" if scale else "features", handleInvalid="skip")]
    if scale:
        stages.append(StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=[*stages, learner])


def boosted_classifier(df: DataFrame, label: str, features: Sequence[str], seed: int = 1, **settings) -> PipelineModel:
    return _pipeline(features, GBTClassifier(labelCol=label, seed=seed, **{**BOOST, **settings})).fit(df)


def boosted_regressor(df: DataFrame, label: str, features: Sequence[str], seed: int = 1, **settings) -> PipelineModel:
    return _pipeline(features, GBTRegressor(labelCol=label, seed=seed, **{**BOOST, **settings})).fit(df)


def forest_classifier(df: DataFrame, label: str, features: Sequence[str], trees: int = 1000, seed: int = 1, **settings) -> PipelineModel:
    return _pipeline(features, RandomForestClassifier(labelCol=label, numTrees=trees, seed=seed, **settings)).fit(df)


def forest_regressor(df: DataFrame, label: str, features: Sequence[str], trees: int = 1000, seed: int = 1, **settings) -> PipelineModel:
    return _pipeline(features, RandomForestRegressor(labelCol=label, numTrees=trees, seed=seed, **settings)).fit(df)


def mlp_classifier(
    df: DataFrame, label: str, features: Sequence[str], hidden: int = 7, epochs: int = 20, classes: int = 2, seed: int = 1
) -> PipelineModel:
    """One hidden layer of sigmoid units on standardised inputs."""
    learner = MultilayerPerceptronClassifier(labelCol=label, layers=[len(features), hidden, classes], maxIter=epochs, seed=seed)
    return _pipeline(features, learner, scale=True).fit(df)


def predict_probability(model: PipelineModel, df: DataFrame, to: str = "prob", positive: int = 1) -> DataFrame:
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[positive].alias(to))


def predict_value(model: PipelineModel, df: DataFrame, to: str = "pred") -> DataFrame:
    return model.transform(df).select(*df.columns, F.col("prediction").alias(to))


def boost_grid(levels: Mapping[str, Sequence]) -> list[dict]:
    """Every combination of the given settings."""
    names = list(levels)
    return [dict(zip(names, values)) for values in product(*levels.values())]


METRICS = {
    "roc_auc": lambda label: BinaryClassificationEvaluator(labelCol=label),
    "pr_auc": lambda label: BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderPR"),
    **{m: lambda label, m=m: RegressionEvaluator(labelCol=label, metricName=m) for m in ("rmse", "mae", "r2")},
    "accuracy": lambda label: MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy"),
    "f1": lambda label: MulticlassClassificationEvaluator(labelCol=label, metricName="f1"),
    "log_loss": lambda label: MulticlassClassificationEvaluator(labelCol=label, metricName="logLoss"),
}


def tune_grid(
    df: DataFrame, label: str, features: Sequence[str], learner, grid: Sequence[Mapping[str, object]], fold: str, folds: int,
    parallelism: int = 4, scale: bool = False, metric: str = "roc_auc",
) -> DataFrame:
    """Mean resampled ``metric`` of each candidate, best first: one of METRICS.

    ``fold`` is an integer column (a hash fold), so every candidate sees the same repeatable resamples;
    candidates are fitted ``parallelism`` at a time, each as a distributed fit.
    """
    pipeline = _pipeline(features, learner, scale)
    evaluator = METRICS[metric](label)
    maps = [{learner.getParam(name): value for name, value in candidate.items()} for candidate in grid]
    cv = CrossValidator(
        estimator=pipeline, estimatorParamMaps=maps, evaluator=evaluator,
        numFolds=folds, foldCol=fold, parallelism=parallelism,
    )
    model = cv.fit(df)
    rows = [
        (", ".join(f"{k}={v}" for k, v in candidate.items()), float(mean), float(sd))
        for candidate, mean, sd in zip(grid, model.avgMetrics, model.stdMetrics)
    ]
    spark: SparkSession = df.sparkSession
    best = F.desc(metric) if evaluator.isLargerBetter() else F.asc(metric)
    return spark.createDataFrame(rows, f"candidate string, {metric} double, sd double").orderBy(best, "candidate")
