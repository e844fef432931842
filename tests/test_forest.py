"""Forests grown level by level: cuts, samples and counts against plain recomputation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialsift.models import forest, runner
from dialsift.models.forest import BalancedSamples, ClassWeights, Grown, grow_forest, poisson_draws, subset_size
from dialsift.models.registry import BY_NAME, FitContext, ModelSizes


def ml_rows(spark, n=900, seed=4):
    rng = np.random.default_rng(seed)
    X = np.round(rng.normal(size=(n, 5)), 2)
    X[:, 4] = 1.0  # constant
    p = 1 / (1 + np.exp(-(2.5 * X[:, 0] - 1.5 * X[:, 1] * (X[:, 2] > 0) - 1)))
    y = (rng.random(n) < p).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), X[i].tolist()) for i in range(n)], "key long, y int, vec array<double>")
    return runner.to_ml(df).repartition(5), X, y


def auc(score, y):
    pos, neg = score[y == 1], score[y == 0]
    return float(((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean())


def walk(grown: Grown, tree: int, x) -> int:
    node = 0
    while grown.feature[tree, node] >= 0:
        node = grown.left[tree, node] + int(x[grown.feature[tree, node]] > grown.cut[tree, node])
    return node


@pytest.mark.parametrize("cuts", ["random", "bins"])
def test_values_are_the_weighted_shares_of_their_rows(spark, cuts):
    ml, X, y = ml_rows(spark)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    grown = grow_forest(ml, 5, 4, 4, cuts, min_leaf=7, min_split=30, seed=1)
    for t in range(4):
        at = np.array([walk(grown, t, x) for x in X])
        assert (at == grown.nodes_of(X, 10)[:, t]).all()
        for node in np.unique(at):
            own = at == node
            assert own.sum() >= 7
            assert grown.value[t, node] == pytest.approx((w * y)[own].sum() / w[own].sum())
    assert not (grown.feature == 4).any()  # a constant feature cuts nothing
    assert auc(grown.scores(X), y) > 0.8


def test_extra_trees_cut_at_random_and_inside_the_nodes_range(spark):
    ml, X, y = ml_rows(spark)
    grown = grow_forest(ml, 5, 30, 3, "random", seed=2)
    for f in range(4):
        roots = grown.cut[:, 0][grown.feature[:, 0] == f]
        assert len(set(roots.tolist())) == len(roots) and ((roots > X[:, f].min()) & (roots < X[:, f].max())).all()
    assert len(set(map(tuple, grown.cut.tolist()))) == 30  # no two trees are alike
    again = grow_forest(ml.repartition(2), 5, 30, 3, "random", seed=2)
    assert (again.cut == grown.cut).all() and (again.feature == grown.feature).all()


def test_extra_trees_tell_held_out_rows(spark):
    data = runner.zoo_data(ml_as_rows(spark), seed=3, datasets=("Original",))
    zoo = runner.run_zoo(data, [BY_NAME["Ensemble_ExtraTrees"], BY_NAME["Ensemble_RandomForest"], BY_NAME["Imbalance_BalancedRandomForest"]],
                         sizes=ModelSizes(trees=40, depth=8))
    rows = {r["nombre"]: r for r in zoo.leaderboard.collect()}
    assert all(r["status"] == "ok" for r in rows.values()), rows
    forest_auc = rows["Ensemble_RandomForest_Original"]["roc_auc"]
    assert all(r["roc_auc"] > forest_auc - 0.05 and r["roc_auc"] > 0.8 for r in rows.values())


def ml_as_rows(spark):
    _, X, y = ml_rows(spark, 1500, 9)
    return spark.createDataFrame([(i, int(y[i]), X[i].tolist()) for i in range(len(y))], "key long, y int, vec array<double>")


def test_balanced_samples_in_one_scan(spark):
    """100 samples: as many draws of either class after levelling, drawn with replacement, no two alike."""
    rng = np.random.default_rng(1)
    y = (np.arange(4000) % 10 == 0).astype(int)
    ml = spark.createDataFrame([(i, int(y[i]), 1.0, rng.normal(size=2).tolist()) for i in range(4000)],
                               "key long, label int, weight double, x array<double>").repartition(6)
    samples = BalancedSamples((3600, 400), 5)
    scans = spark.sparkContext.accumulator(0)
    counted = ml.mapInPandas(lambda batches: (scans.add(len(b)) or b for b in batches), ml.schema)
    totals = samples.level(counted, 100)
    assert scans.value == 4000 and totals.shape == (2, 100)
    drawn = samples(np.arange(4000), y, None, 100)
    assert np.allclose(drawn[y == 0].sum(axis=0), drawn[y == 1].sum(axis=0)) and drawn.max() > 1
    assert (totals[1] > 320).all() and (totals[1] < 480).all() and (totals[0] > 320).all() and (totals[0] < 480).all()
    assert len({tuple(c) for c in drawn.T.tolist()}) == 100


def test_draws_are_poisson():
    drawn = poisson_draws(np.arange(200_000), np.full(200_000, 0.7), 3, 2)
    assert abs(drawn.mean() - 0.7) < 0.01 and abs(drawn.var() - 0.7) < 0.02 and abs((drawn == 0).mean() - np.exp(-0.7)) < 0.01
    assert (drawn == poisson_draws(np.arange(200_000), np.full(200_000, 0.7), 3, 2)).all()


def test_scans_of_few_nodes_grow_the_same_trees(spark, monkeypatch):
    """Level by level in groups of nodes: bins give the same best cuts whatever the group."""
    ml, X, _ = ml_rows(spark, 400)
    whole = grow_forest(ml, 5, 3, 4, "bins", subset="all", seed=6)
    monkeypatch.setattr(forest, "CELLS", 2 * 5 * forest.BINS * 3)
    parts = grow_forest(ml, 5, 3, 4, "bins", subset="all", seed=6)
    assert np.allclose(parts.scores(X), whole.scores(X))
    best = [(c, f) for f in range(4) for c in np.unique(X[:, f])]
    assert whole.feature[0, 0] in {f for _, f in best} and len(set(whole.cut[:, 0].tolist())) == 1


def test_subsets_and_one_class(spark):
    assert [subset_size(s, 64) for s in ("sqrt", "log2", "all", "0.5")] == [8, 6, 64, 32] and subset_size("sqrt", 1) == 1
    ml, X, _ = ml_rows(spark, 60)
    only = ml.withColumn("label", F.lit(1.0))
    assert (grow_forest(only, 5, 2, 3, "random").scores(X) == 1.0).all()
    with pytest.raises(ValueError, match="both classes"):
        BY_NAME["Imbalance_BalancedRandomForest"].build(FitContext(60, 5, 1.0))(only)
    assert ClassWeights()(None, None, np.array([1.0, 2.0]), 3).shape == (2, 3)
