"""Zoo models: planted signal, closed forms, sizes, saving, tuning that fits what it reports."""

import math
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialsift.models import registry, runner, tuning
from dialsift.models.registry import BY_NAME, FitContext, FittedModel, ModelSizes
from dialsift.operators import metrics

SMALL = ModelSizes(trees=10, depth=4, rounds=5, iterations=50)


def planted(spark, n=600, w=(1.5, -1.0, 0.5, 0.0), shift=-1.0, seed=5):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, len(w)))
    y = (rng.random(n) < 1 / (1 + np.exp(-(X @ np.array(w) + shift)))).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), X[i].tolist()) for i in range(n)], "key long, y int, vec array<double>")
    return df, X, y


def original(spark, **kw):
    data = runner.zoo_data(planted(spark, **kw)[0], seed=3, datasets=("Original",))
    data.errors = {}
    return data


def test_planted_signal_and_leaderboard_metrics(spark):
    data = original(spark, n=2000, w=(2.0, -1.0, 0.5), shift=0.0, seed=11)
    names = ("Linear_LogisticRegression", "Linear_LinearDiscriminant", "Linear_RidgeClassifier", "Linear_QuadraticDiscriminant")
    zoo = runner.run_zoo(data, [BY_NAME[n] for n in names], parallelism=1)
    rows = {r["run_id"]: r for r in zoo.leaderboard.collect()}
    assert all(r["status"] == "ok" and r["roc_auc"] > 0.8 for r in rows.values())
    for run, r in rows.items():  # recomputed from the stored scores
        s = [(x["score"], x["y"], x["pred"]) for x in zoo.scores.where(F.col("run_id") == run).collect()]
        tp = sum(y and p for _, y, p in s)
        assert r["precision"] == pytest.approx(tp / max(1, sum(p for *_, p in s)))
        assert r["recall"] == pytest.approx(tp / sum(y for _, y, _ in s))
        pos, neg = [a for a, y, _ in s if y], [a for a, y, _ in s if not y]
        assert r["roc_auc"] == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))


def test_every_registry_model_fits(spark):
    """All 25 zoo entries fit and score at explicit small sizes."""
    zoo = runner.run_zoo(original(spark), sizes=SMALL)
    rows = zoo.leaderboard.collect()
    bad = [(r["nombre"], r["status"]) for r in rows if r["status"] != "ok"]
    assert len(rows) == 25 and not bad, bad
    assert zoo.scores.where("score IS NULL").count() == 0 and len(zoo.models) == 25


def test_default_sizes_are_the_references():
    ctx = FitContext(n_train=10, n_features=2, scale_pos_weight=1.0)
    assert ctx.size("trees", 200) == 200 and ctx.size("rounds", 200) == 200 and ctx.size("iterations", 1000) == 1000
    assert FitContext(10, 2, 1.0, sizes=SMALL).size("trees", 200) == 10
    assert len(registry.REGISTRY) == 25


def test_logistic_gradient_is_zero(spark):
    """the C-form objective (weighted log-loss summed + |w|^2 / 2) is stationary at the fit."""
    df, X, y = planted(spark, n=400, w=(1.0, -0.5), seed=2)
    ml = runner.to_ml(df).cache()
    fitted = BY_NAME["Linear_LogisticRegression"].build(FitContext(400, 2, 1.0))(ml)
    m = fitted.models[0]
    w, b = m.coefficients.toArray(), m.intercept
    sw = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    p = 1 / (1 + np.exp(-(X @ w + b)))
    grad = X.T @ (sw * (p - y)) + w
    assert np.abs(grad).max() < 1e-2 * len(y) and abs((sw * (p - y)).sum()) < 1e-2 * len(y)


def test_quadratic_discriminant_closed_form(spark):
    df, X, y = planted(spark, n=500, w=(1.0, -0.5), seed=4)
    ml = runner.to_ml(df)
    fitted = BY_NAME["Linear_QuadraticDiscriminant"].build(FitContext(500, 2, 1.0))(ml)
    got = {r["key"]: r["score"] for r in fitted.transform(ml).select("key", "score").collect()}

    def density(x, c):
        a = X[y == c]
        cov, d = np.cov(a.T), x - a.mean(0)
        return len(a) * math.exp(-0.5 * d @ np.linalg.inv(cov) @ d) / math.sqrt(np.linalg.det(cov))

    for i in range(0, 500, 50):
        p1, p0 = density(X[i], 1), density(X[i], 0)
        assert got[i] == pytest.approx(p1 / (p0 + p1), abs=1e-6)


@pytest.mark.parametrize("name", ["Linear_LogisticRegression", "Linear_RidgeClassifier", "Linear_LinearDiscriminant", "SVM_SVC_Linear",
                                  "KNN_K5", "Ensemble_AdaBoost", "Imbalance_BalancedRandomForest", "NaiveBayes_BernoulliNB"])
def test_save_and_load(spark, name):
    ml = runner.to_ml(planted(spark, n=200)[0])
    fitted = BY_NAME[name].build(FitContext(200, 4, 1.0, sizes=SMALL))(ml)
    path = os.path.join(spark.sparkContext.getCheckpointDir(), f"model-{uuid.uuid4().hex}")
    fitted.save(path)
    again = FittedModel.load(spark, path)
    score = lambda m: {r["key"]: r["score"] for r in m.transform(ml).select("key", "score").collect()}
    assert score(again) == score(fitted)


SPACES = {"RandomForest": {"numTrees": (3, 7), "maxDepth": (2, 6)}, "BalancedRandomForest": {"numTrees": (2, 3), "maxDepth": (2,)}}


def test_reported_parameters_are_the_fitted_ones(spark):
    data = original(spark)
    t = tuning.tune_model("Ensemble_RandomForest", data.train, data.test, n_iter=3, cv=2, spaces=SPACES)
    forest = t.model.models[0]
    assert t.tuned and forest.getNumTrees == t.params["numTrees"] and forest.getMaxDepth() == t.params["maxDepth"]
    again = metrics.all_metrics(t.scores.withColumn("run", F.lit(0)), ["run"]).first()
    assert again["f1"] == t.metrics["f1"]


def test_balanced_forest_is_tuned_as_itself_and_untuned_models_have_no_auc(spark):
    data = original(spark)
    t = tuning.tune_model("Imbalance_BalancedRandomForest", data.train, data.test, n_iter=2, cv=2, spaces=SPACES)
    assert t.model.kind == "forest" and len(t.model.params["feature"]) == t.params["numTrees"]
    u = tuning.tune_model("Linear_RidgeClassifier", data.train, data.test, spaces=SPACES, n_features=4)
    assert not u.tuned and u.metrics["roc_auc"] == 0.0 and u.cv_score == u.metrics["f1"]


def test_reference_grids():
    size = lambda name: math.prod(len(v) for v in tuning.search_space(name).values())
    assert all(size(n) >= 150 for n in ("Ensemble_RandomForest", "GradBoost_XGBoost", "GradBoost_LightGBM", "GradBoost_CatBoost"))
    assert tuning.search_space("Linear_RidgeClassifier") is None
    drawn = tuning.draw_candidates(tuning.search_space("Ensemble_RandomForest"), 150, 73)
    assert len({str(sorted(p.items())) for p in drawn}) == 150


def test_squared_hinge_has_zero_gradient(spark):
    """|w|^2/2 + sum s max(0, 1 - t f)^2 with the intercept penalised is stationary, and no plain step lowers it."""
    df, X, y = planted(spark, n=400, w=(1.0, -0.5, 3.0), seed=2)
    fitted = BY_NAME["SVM_LinearSVC"].build(FitContext(400, 3, 1.0))(runner.to_ml(df))
    w = np.array([*fitted.params["w"], fitted.params["b"]])
    A, t = np.column_stack([X, np.ones(400)]), 2.0 * y - 1
    s = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))

    def loss(v):
        return v @ v / 2 + (s * np.maximum(0, 1 - t * (A @ v)) ** 2).sum()

    gap = np.maximum(0, 1 - t * (A @ w))
    assert np.abs(w - 2 * A.T @ (s * t * gap)).max() < 1e-6
    assert all(loss(w) <= loss(w + 1e-3 * e) for e in np.vstack([np.eye(4), -np.eye(4)]))
    scores = {r["key"]: r["score"] for r in fitted.transform(runner.to_ml(df)).collect()}
    assert np.allclose([scores[k] for k in range(400)], A @ w)


def test_mlp_stops_early_and_keeps_the_best_weights(spark, monkeypatch):
    """Labels without signal: the held-out accuracy soon stops rising."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, int(rng.random() < 0.5), rng.normal(size=3).tolist()) for i in range(300)], "key long, y int, vec array<double>")
    ml = runner.to_ml(df)
    monkeypatch.setattr(registry, "MLP_PATIENCE", 3)
    fitted = BY_NAME["NeuralNet_MLP_Small"].build(FitContext(300, 3, 1.0))(ml)
    assert 3 < fitted.params["rounds"] < 200 / registry.MLP_ROUND
    from dialsift.operators.sampling import stratified_split

    held = stratified_split(ml, "key", "label", 0.1, 73).where("split = 'test'").drop("split")
    got = fitted.models[0].transform(held).select((F.col("prediction") == F.col("label")).cast("double").alias("ok")).agg(F.avg("ok")).first()[0]
    assert got == pytest.approx(fitted.params["held_out_accuracy"])


def test_equal_entries_share_a_fit(spark):
    """Both decision trees, and both weighted boosters, are one fit each: 23 fits for 25 rows, equal scores."""
    names = ["Tree_DecisionTree", "Tree_DecisionTree_Deep", "GradBoost_XGBoost", "GradBoost_LightGBM", "Linear_RidgeClassifier"]
    zoo = runner.run_zoo(original(spark), [BY_NAME[n] for n in names], sizes=SMALL)
    rows = {r["modelo_base"]: r for r in zoo.leaderboard.collect()}
    assert zoo.fits == 3 and len(rows) == 5 and len(zoo.models) == 5
    for a, b in (names[:2], names[2:4]):
        assert [rows[a][c] for c in ("precision", "recall", "f1", "roc_auc", "pr_auc")] == [rows[b][c] for c in ("precision", "recall", "f1", "roc_auc", "pr_auc")]
    assert len({(m.fits_as or m.name) for m in registry.REGISTRY}) == 23
    only = runner.run_zoo(original(spark), [BY_NAME["Tree_DecisionTree_Deep"]], sizes=SMALL)  # without the entry it shares with
    assert only.leaderboard.first()["status"] == "ok"


def test_user_models_enter_the_zoo(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import PCA

    pipe = Pipeline(stages=[PCA(k=2, inputCol="features", outputCol="pca"), LogisticRegression(featuresCol="pca", labelCol="label")])
    fitted = LogisticRegression(labelCol="label").fit(runner.to_ml(planted(spark)[0]))
    specs = [registry.user_model("mine", pipe), registry.user_model("weighted", LogisticRegression(labelCol="label", maxIter=5), weighted=True),
             registry.user_model("fitted", fitted), registry.user_model("broken", Pipeline(stages=[PCA(k=99, inputCol="features", outputCol="p")]))]
    zoo = runner.run_zoo(original(spark), specs)
    status = {r["modelo_base"]: r["status"] for r in zoo.leaderboard.collect()}
    assert [status[n] for n in ("mine", "weighted", "fitted")] == ["ok"] * 3 and status["broken"].startswith("error")
    assert zoo.leaderboard.filter("status = 'ok' AND roc_auc > 0.7").count() == 3
