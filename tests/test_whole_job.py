"""The registered model queries fit the whole zoo at the reference's sizes: no limits are passed; fits of many rounds."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from dialsift.models import runner
from dialsift.models.registry import BY_NAME, REGISTRY, FitContext, FittedModel, ModelSizes
from dialsift.models.tuning import search_space
from dialsift.plans import catalog
from dialsift.session import write_shared


class Called(Exception):
    """Raised in place of the fits; holds what they were asked for."""


def raiser(*args, **kw):
    raise Called(args, kw)


def limits(kw):
    return {k: v for k, v in kw.items() if k in ("models", "dataset_names", "sizes", "spaces", "n_iter") and v not in (None, ModelSizes())}


@pytest.mark.parametrize("name", ["evaluation_business_metrics", "evaluation_improvement_80"])
def test_evaluation_has_no_limits(spark, monkeypatch, name):
    monkeypatch.setattr(catalog, "attempts", lambda spark, sf_dir: None)
    monkeypatch.setattr(catalog, "_evaluate", raiser)
    monkeypatch.setattr(catalog, "_STORES", {})
    with pytest.raises(Called) as found:
        catalog.QUERIES[name](spark, "rows")
    args, kw = found.value.args
    assert len(args) == 1 and limits(kw) == {}


@pytest.mark.parametrize("name", ["zoo_results", "zoo_results_stored"])
def test_zoo_has_no_limits(spark, monkeypatch, name):
    monkeypatch.setattr(catalog, "embedding_rows", lambda spark, sf_dir: None)
    monkeypatch.setattr(catalog.zoo_runner, "zoo_data", lambda rows, **kw: None)
    monkeypatch.setattr(catalog.zoo_runner, "run_zoo", raiser)
    monkeypatch.setattr(catalog, "_STORES", {})
    with pytest.raises(Called) as found:
        catalog.QUERIES[name](spark, "rows")
    args, kw = found.value.args
    assert set(args) <= {None} and limits(kw) == {}


def test_tuning_has_no_limits(spark, monkeypatch):
    zoo = {}

    def run_zoo(*args, **kw):
        zoo.update(kw, models=args[1])
        return catalog.zoo_runner.Zoo(spark.range(1), None, {})

    monkeypatch.setattr(catalog, "embedding_rows", lambda spark, sf_dir: None)
    monkeypatch.setattr(catalog.zoo_runner, "zoo_data", lambda rows, **kw: catalog.zoo_runner.ZooData(None, None, {}, 1))
    monkeypatch.setattr(catalog.zoo_runner, "run_zoo", run_zoo)
    monkeypatch.setattr(catalog.selection, "select_best", lambda leaderboard: leaderboard)
    monkeypatch.setattr(catalog.zoo_tuning, "tune_best", raiser)
    with pytest.raises(Called) as found:
        catalog.QUERIES["tune_best"](spark, "rows")
    models = zoo.pop("models")
    assert {m.name for m in models} == {m.name for m in REGISTRY if search_space(m.name)}
    assert limits(zoo) == {} and limits(found.value.args[1]) == {}


def boosted(spark, rounds):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(300, 3))
    y = (X[:, 0] + X[:, 1] ** 2 + rng.normal(size=300) > 0.7).astype(float)
    rows = write_shared(spark.createDataFrame([(i, float(y[i]), 1.0, Vectors.dense(X[i])) for i in range(300)], ["key", "label", "weight", "features"]), "rows")
    return rows, BY_NAME["Ensemble_AdaBoost"].build(FitContext(300, 3, 1.0, sizes=ModelSizes(rounds=rounds)))(rows)


def test_stump_votes_are_those_of_the_fitted_trees(spark):
    rows, model = boosted(spark, 6)
    assert len(model.models) == 6
    votes = np.zeros(300)
    weights = np.full(300, 1 / 300)
    labels = np.array([r["label"] for r in rows.orderBy("key").collect()])
    for alpha, stump in zip(model.params["alphas"], model.models, strict=True):
        side = np.array([r["prediction"] for r in stump.transform(rows).orderBy("key").collect()])
        missed = weights[side != labels].sum() / weights.sum()
        assert alpha == pytest.approx(np.log((1 - missed) / missed), rel=1e-9)
        weights = weights * np.exp(alpha * (side != labels))
        votes += alpha * (2 * side - 1)
    got = np.array([r["score"] for r in model.transform(rows).orderBy("key").collect()])
    assert got == pytest.approx((votes / sum(model.params["alphas"]) + 1) / 2)


def test_plan_of_stump_votes_does_not_grow_with_the_rounds(spark):
    rows, model = boosted(spark, 12)
    plan = lambda m: m.transform(rows)._jdf.queryExecution().analyzed().toString().count("Project")
    fewer = FittedModel("stumps", model.models[:2], {"alphas": model.params["alphas"][:2]})
    assert plan(model) == plan(fewer)


def test_small_sets_are_few_tasks_and_many_fits(spark):
    rows = spark.range(64, numPartitions=8)
    assert runner.few_tasks(rows, 64, 10).rdd.getNumPartitions() == 1
    assert sorted(r["id"] for r in runner.few_tasks(rows, 64, 10).collect()) == list(range(64))
    assert runner.few_tasks(rows, 64, 10 * runner.CELLS) is rows  # large sets keep their tasks
    cores = spark.sparkContext.defaultParallelism
    assert runner.fits_at_once([spark.range(9, numPartitions=1)]) == max(runner.FITS, min(runner.MOST_FITS, cores))
    assert runner.fits_at_once([spark.range(9, numPartitions=1), spark.range(99, numPartitions=99 * cores)]) == runner.FITS
