"""Stored results and the evaluator for Spark ML's own tuning."""

import os
import uuid

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from dialsift.models import runner, tuning
from dialsift.models.evaluator import RecallAtPrecision
from dialsift.models.registry import BY_NAME, ModelSizes
from dialsift.models.store import ResultStore
from dialsift.operators import ranking, sampling

from .test_models import original, planted


@pytest.fixture
def store(spark):
    return ResultStore(spark, os.path.join(spark.sparkContext.getCheckpointDir(), f"store-{uuid.uuid4().hex}"))


def rows(df):
    return sorted(map(str, df.collect()))


def test_storing_twice_gives_the_same_tables(spark, store):
    zoo = runner.run_zoo(original(spark), [BY_NAME["Linear_RidgeClassifier"], BY_NAME["NaiveBayes_GaussianNB"]])
    scores = zoo.scores.select(F.concat(F.lit("run "), "run_id").alias("estrategia"), "key", "score", "y")
    assert store.experiments() == []
    store.save("a", zoo.leaderboard, scores)
    store.save("b", zoo.leaderboard.limit(1))
    before = {name: rows(store.read(name)) for name in ("leaderboard", "scores", "curves")}
    store.save("a", zoo.leaderboard, scores)
    assert {name: rows(store.read(name)) for name in before} == before and len(before["leaderboard"]) == 3
    assert store.experiments() == ["a", "b"]
    assert rows(store.read("curves", "a").select("estrategia", "key", "contactos_acum")) == rows(ranking.gain_curve(scores).select("estrategia", "key", "contactos_acum"))
    store.save("a", zoo.leaderboard.limit(1))  # a later run replaces its own rows only
    assert store.read("leaderboard", "a").count() == 1 and store.read("leaderboard", "b").count() == 1
    with pytest.raises(KeyError):
        store.read("models")


def test_evaluator_follows_its_rule(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 1.0)], "label double, prediction double")
    assert RecallAtPrecision(minPrecision=0.3).evaluate(df) == pytest.approx(0.5)
    assert RecallAtPrecision(minPrecision=0.4).evaluate(df) == pytest.approx(0.5 - 2 * (0.4 - 1 / 3))
    other = df.withColumnsRenamed({"label": "y", "prediction": "p"})
    assert RecallAtPrecision(minPrecision=0.3, labelCol="y", predictionCol="p").evaluate(other) == pytest.approx(0.5)
    assert RecallAtPrecision().isLargerBetter() and RecallAtPrecision().evaluate(df.limit(0)) == 0.0
    path = f"{spark.sparkContext.getCheckpointDir()}/evaluator-{uuid.uuid4().hex}"
    RecallAtPrecision(minPrecision=0.25).save(path)
    assert RecallAtPrecision.load(path).getOrDefault("minPrecision") == 0.25


def test_cross_validator_chooses_as_tune_model(spark):
    """A fixed grid on the same folds: CrossValidator with foldCol and the evaluator picks what the search picks."""
    data = original(spark, n=800)
    space = {"GradientBoosting": {"maxIter": (1, 4), "maxDepth": (1, 3), "stepSize": (0.3,)}}
    found = tuning.tune_model("Ensemble_GradientBoosting", data.train, data.test, "recall", n_iter=99, cv=3, min_precision=0.45, spaces=space)
    ml = runner.to_ml(data.train)
    folds = sampling.stratified_folds(data.train.select("key", "y"), "key", "y", 3, 73)
    rows_ = ml.join(folds.select("key", F.col("fold").cast("int").alias("fold")), "key")
    if rows_.agg(F.min("fold")).first()[0] == 1:
        rows_ = rows_.withColumn("fold", F.col("fold") - 1)
    boosted = GBTClassifier(labelCol="label", stepSize=0.3, seed=73)
    grid = ParamGridBuilder().addGrid(boosted.maxIter, [1, 4]).addGrid(boosted.maxDepth, [1, 3]).build()
    model = CrossValidator(estimator=boosted, estimatorParamMaps=grid, evaluator=RecallAtPrecision(minPrecision=0.45), numFolds=3, foldCol="fold").fit(rows_)
    best = grid[int(np.argmax(model.avgMetrics))]
    assert {p.name: v for p, v in best.items()} == {k: found.params[k] for k in ("maxIter", "maxDepth")}
    assert max(model.avgMetrics) == pytest.approx(found.cv_score)


def test_leaderboard_of_all_sets_is_stored(spark, store):
    data = runner.zoo_data(planted(spark, n=300)[0], seed=3)
    zoo = runner.run_zoo(data, [BY_NAME["Linear_LinearDiscriminant"]], sizes=ModelSizes())
    store.save("sets", zoo.leaderboard)
    assert sorted(r["tipo_dataset"] for r in store.read("leaderboard", "sets").collect()) == sorted(data.datasets)
