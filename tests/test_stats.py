"""Correlation (pairwise-complete, zero variance), S9 pruning, exact medians, scaler."""

import random

import numpy as np
from pyspark.sql import functions as F

from dialsift.operators import stats


def test_chain_prune_and_zero_variance(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        a = rnd.gauss(0, 1)
        b = a + rnd.gauss(0, 0.05)
        c = b + rnd.gauss(0, 0.05)
        d = rnd.gauss(0, 1) if i % 7 else None  # NULL holes
        rows.append((a, b, c, d, 1.0))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, k double")
    cols = ["a", "b", "c", "d", "k"]
    pairs = stats.correlation_pairs(df, cols)
    got = {(r["col_i"], r["col_j"]): r["r"] for r in pairs.collect()}
    X = np.array([[np.nan if v is None else v for v in r] for r in rows])
    for (i, j), r in got.items():
        if "k" in (i, j):
            assert r is None  # zero variance never pruned
            continue
        xi, xj = X[:, cols.index(i)], X[:, cols.index(j)]
        m = ~np.isnan(xi) & ~np.isnan(xj)
        assert abs(abs(np.corrcoef(xi[m], xj[m])[0, 1]) - r) < 1e-9
    # B goes (a~b), c goes (a~c and b~c) even though b itself is dropped
    assert stats.correlation_drop_list(pairs, cols) == ["b", "c"]


def test_exact_medians_with_narrowed_brackets(spark):
    vals = [float(v) for v in np.random.default_rng(0).integers(0, 50, 301)] + [None] * 5
    df = spark.createDataFrame([(v, (v or 0) * 0.5 + 0.1) for v in vals], "x double, y double")
    expect_x = float(np.median([v for v in vals if v is not None]))
    expect_y = float(np.median([(v or 0) * 0.5 + 0.1 for v in vals]))
    fast = stats.exact_medians(df, ["x", "y"])
    slow = stats.exact_medians(df, ["x", "y"], accuracy=20, inside_limit=1)  # brackets are narrowed again and again
    for got in (fast, slow):
        assert got["x"] == expect_x
        assert abs(got["y"] - expect_y) < 1e-12


def test_scaler_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    p = stats.fit_standard_scaler(df, ["a", "b"])
    out = stats.apply_standard_scaler(df, p).orderBy("a").collect()
    assert [r["a"] for r in out] == [-1.0, 1.0]  # population std (not ±0.7071)
    assert [r["b"] for r in out] == [0.0, 0.0]  # zero std divides by 1


def test_exact_medians_bracket_miss_falls_back(spark, monkeypatch):
    # accuracy 1 gives a useless bracket (the whole range): the result must still be exact
    rng = np.random.default_rng(4)
    vals = rng.normal(size=2001).tolist()
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = stats.exact_medians(df, ["x"], accuracy=1)
    assert got["x"] == float(np.median(vals))
    got = stats.exact_medians(df, ["x"], accuracy=100000)
    assert got["x"] == float(np.median(vals))


def test_correlation_does_not_depend_on_the_first_row(spark):
    rows = [(None, None)] + [(1e8 + k, 2e8 + 2.0 * k) for k in range(50)]
    outlier = [(-1e8, -2e8)] + rows[1:]
    for data in (rows, outlier):
        df = spark.createDataFrame(data, "a double, b double").coalesce(1)
        r = stats.correlation_pairs(df, ["a", "b"]).first()["r"]
        assert abs(r - 1.0) < 1e-6


def test_minmax(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 2.0), (5.0, 2.0)], "a double, b double")
    got = [(r["a"], r["b"]) for r in stats.minmax(df, ["a", "b"]).orderBy("a").collect()]
    assert got[0] == (0.0, None) and got[1][1] == 0.0 and abs(got[2][0] - 4 / (4 + 1e-6)) < 1e-12


def test_correlations_of_thousands_of_columns(spark):
    """3,000 columns with gaps in tiles: no task holds a matrix of all pairs, values as numpy gives them."""
    rng = np.random.default_rng(7)
    n, p = 60, 3000
    X = rng.normal(size=(n, p)) + rng.normal(size=(n, 1))
    X[rng.random((n, p)) < 0.1] = np.nan
    X[:, 17] = 3.0
    schema = ", ".join(f"c{k} double" for k in range(p))
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in X], schema)
    passes = stats._passes(p)
    assert all(len(a) <= stats.TILE and len(b) <= stats.TILE for tiles in passes for a, b in tiles) and max(map(len, passes)) <= 64
    assert sum(len(a) * len(b) if a != b else len(a) * (len(a) - 1) // 2 for tiles in passes for a, b in tiles) == p * (p - 1) // 2
    out = stats.correlation_pairs(df, df.columns, absolute=False)
    some = [(0, 1), (5, 2999), (17, 40), (130, 300), (127, 128), (2048, 2900)]
    got = {(r["col_i"], r["col_j"]): r["r"] for r in out.where(F.concat_ws(",", "col_i", "col_j").isin([f"c{i},c{j}" for i, j in some])).collect()}
    for i, j in some:
        both = ~np.isnan(X[:, i]) & ~np.isnan(X[:, j])
        if i == 17:
            assert got["c17", f"c{j}"] is None
        else:
            assert abs(got[f"c{i}", f"c{j}"] - np.corrcoef(X[both, i], X[both, j])[0, 1]) < 1e-9
    assert out.count() == p * (p - 1) // 2


def test_small_tiles_and_target_only(spark, monkeypatch):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(200, 11))
    df = spark.createDataFrame([tuple(map(float, r)) for r in X], ", ".join(f"c{k} double" for k in range(11)))
    whole = {(r["col_i"], r["col_j"]): r["r"] for r in stats.correlation_pairs(df, df.columns).collect()}
    monkeypatch.setattr(stats, "TILE", 3)
    monkeypatch.setattr(stats, "TILES_ON_A_SIDE", 2)
    tiled = {(r["col_i"], r["col_j"]): r["r"] for r in stats.correlation_pairs(df, df.columns).collect()}
    assert tiled.keys() == whole.keys() and all(abs(tiled[k] - whole[k]) < 1e-12 for k in whole)
    target = {r["Feature"]: r["Correlacion_Abs"] for r in stats.target_correlations(df, df.columns[:-1], "c10").collect()}
    assert target.keys() == {f"c{k}" for k in range(10)} and all(abs(target[c] - whole[c, "c10"]) < 1e-12 for c in target)
    assert stats.target_correlations(df, [], "c10").count() == 0


def test_scaler_skips_nulls_and_keeps_large_means(spark):
    """The moments of the tasks' batches equal those of all rows, also where a task has no value."""
    rows = [(float(k) + 1e9, None if k % 3 else k * 0.5, None, 7.0, float("nan") if k == 5 else 1.0) for k in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(7)
    got = stats.fit_standard_scaler(df, list("abcde"))
    b = np.array([k * 0.5 for k in range(500) if k % 3 == 0])
    assert np.allclose(got["a"], (1e9 + 249.5, np.arange(500).std()), rtol=1e-12) and np.allclose(got["b"], (b.mean(), b.std()))
    assert got["c"] == (0.0, 1.0) and got["d"] == (7.0, 1.0) and np.isnan(got["e"][0]) and got["e"][1] == 1.0
    assert stats.fit_standard_scaler(df.limit(0), ["a"]) == {"a": (0.0, 1.0)}


def test_split_rows_are_not_copied(spark, monkeypatch):
    from dialsift.plans import prepare

    names, plain = [], prepare.write_shared
    monkeypatch.setattr(prepare, "write_shared", lambda df, name: names.append(name) or plain(df, name))
    data = spark.createDataFrame([(k, float(k % 10), k % 2) for k in range(100)], "CODIGO long, f double, CD int")
    sd = prepare.split_and_scale(prepare.Prepared(data, ["f"], [], [], {}))
    assert names == [] and sd.test.count() == 20 and sd.train.count() == 80
