"""kNN block-pair path equals the broadcast path; SMOTE points lie on segments; class counts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dialsift.operators import knn, knn_tree, resample, sampling
from dialsift.session import write_shared


def _vecs(spark, n=300, d=8, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d))
    rows = [(i, int(i % 9 == 0), X[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "key long, y int, vec array<double>"), X


def test_block_equals_broadcast(spark):
    df, _ = _vecs(spark)
    a = knn.knn(df, df, 4).orderBy("key", "rank").collect()
    b = knn.knn(df, df, 4, broadcast_limit=0, block_rows=64).orderBy("key", "rank").collect()
    assert [(r["key"], r["neighbour"]) for r in a] == [(r["key"], r["neighbour"]) for r in b]


def test_blocks_over_attempt_features(spark):
    """The pair form over the prepared attempt features, with blocks that pruning leaves out."""
    from dialsift.plans.prepare import prepare, split_and_scale
    from dialsift.sources.attempts import attempts

    from .conftest import SF001

    sd = split_and_scale(prepare(attempts(spark, SF001)))
    df = sd.train.select(F.col("CODIGO").alias("key"), F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in sd.features]).alias("vec"))
    a = knn.knn(df, df, 3).orderBy("key", "rank").collect()
    b = knn.knn(df, df, 3, broadcast_limit=0, block_rows=100).orderBy("key", "rank").collect()
    assert [(r["key"], r["neighbour"]) for r in a] == [(r["key"], r["neighbour"]) for r in b]
    assert knn.knn(df, df, 3, broadcast_bytes=1000, block_rows=500).count() == len(a)


def _same(a, b):
    key = lambda r: (r["key"], r["rank"], r["neighbour"], round(r["distance"], 9))
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def test_tree_of_clusters(spark):
    """Well separated clusters, one with a third of the rows; k beyond the rows of a leaf."""
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(size=4) + 50.0 * (k % 12 if k % 3 else 0)).tolist()) for k in range(1200)]
    df = spark.createDataFrame(rows, "key long, vec array<double>")
    for k in (1, 4, 70):
        _same(knn.knn(df, df, k), knn.knn(df, df, k, broadcast_limit=0, block_rows=60))
    other = spark.createDataFrame([(k, (rng.normal(size=4) * 300).tolist()) for k in range(90)], "key long, vec array<double>")
    _same(knn.knn(other, df, 5, exclude_self=False), knn.knn(other, df, 5, exclude_self=False, broadcast_limit=0, block_rows=60))


def test_tree_with_copies_and_ties(spark):
    """A vector that holds a third of the rows is one reference row; equal distances go by key."""
    rng = np.random.default_rng(2)
    rows = [(k, [0.0, 1.0, -0.0] if k % 3 == 0 else rng.integers(0, 4, 3).astype(float).tolist()) for k in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(k), v) for k, v in rows], "key long, vec array<double>")
    for k in (1, 3, 20):
        _same(knn.knn(df, df, k), knn.knn(df, df, k, broadcast_limit=0, block_rows=10))
    assert knn_tree.distinct_vectors(df, 6).count() == 64


def test_rows_the_tree_cannot_narrow(spark, monkeypatch):
    """Unclustered rows of many dimensions are within reach of every leaf: they leave the rounds after the first and meet
    packed blocks instead of being dealt to each leaf."""
    names, plain = [], knn_tree.write_shared
    monkeypatch.setattr(knn_tree, "write_shared", lambda df, name: names.append(name) or plain(df, name))
    monkeypatch.setattr(knn_tree, "BLOCK_BYTES", 300 * 8 * 24)
    rng = np.random.default_rng(3)
    X = rng.normal(size=(2000, 24))
    X[::50] = X[7]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(X.tolist())], "key long, vec array<double>")
    for k in (1, 6, 45):
        names.clear()
        _same(knn.knn(df, df, k), knn.knn(df, df, k, broadcast_limit=0, block_rows=40))
        assert names.count("knn-round") <= (2 if k < 40 else 3)


def test_within_bound(spark):
    """Candidates by single precision lose no neighbour, whatever the scale of the numbers."""
    rng = np.random.default_rng(4)
    two = np.concatenate([rng.normal(size=(300, 5)) * 1e-4 - 1e4, rng.normal(size=(300, 5)) * 1e-4 + 1e4])
    odd = rng.normal(size=(400, 5))
    odd[3], odd[5] = np.nan, np.inf
    for R in (odd, rng.normal(size=(400, 30)) * 1e-3 + 1e4, odd[10:] * 1e-30, odd[10:] * 1e25, rng.integers(0, 3, (400, 3)).astype(float), two):
        Q, k = R[10::7], 4
        d = np.nan_to_num(np.sqrt(((Q[:, None] - R[None]) ** 2).sum(2)), nan=np.inf)
        nearest = np.argsort(d, axis=1, kind="stable")[:, :k]
        bound = np.take_along_axis(d, nearest[:, -1:], 1)[:, 0]
        row, at, distance = knn_tree.within_bound(Q, bound, R, k)
        assert {(n, m) for n in range(len(Q)) for m in np.flatnonzero(d[n] < bound[n]).tolist()} <= set(zip(row.tolist(), at.tolist()))
        assert {(n, m) for n, ms in enumerate(nearest.tolist()) for m in ms} <= set(zip(row.tolist(), at.tolist())) and (distance == d[row, at]).all()


def test_tree_of_few_rows(spark):
    empty = spark.createDataFrame([], "key long, vec array<double>")
    one = spark.createDataFrame([(7, [1.0, 2.0])], "key long, vec array<double>")
    assert knn.knn(one, empty, 3, broadcast_limit=-1).count() == 0 and knn.knn(empty, one, 3, broadcast_limit=-1).count() == 0
    assert knn.knn(one, one, 3, broadcast_limit=-1).count() == 0  # only itself
    assert [tuple(r) for r in knn.knn(one, one, 3, exclude_self=False, broadcast_limit=-1).collect()] == [(7, 7, 1, 0.0)]


def test_pairs_stay_few_among_a_million_rows(spark):
    """10^6 clustered rows: under 5 % of all query and reference pairs are compared, and every neighbour is right."""
    n, m, k = 1_000_000, 4000, 5
    rng = np.random.default_rng(5)
    centres = spark.sparkContext.broadcast(rng.uniform(0, 1000, (300, 6)))

    def draw(batches):
        for b in batches:
            own = np.random.default_rng(int(b["id"].iloc[0]) if len(b) else 0)
            X = centres.value[own.integers(0, 300, len(b))] + own.normal(size=(len(b), 6))
            yield pd.DataFrame({"key": b["id"], "vec": list(X)})

    ref = write_shared(spark.range(0, n, 1, 64).mapInPandas(draw, "key long, vec array<double>"), "million")
    query = write_shared(ref.filter(F.col("key") % (n // m) == 0), "queries")
    pairs = spark.sparkContext.accumulator(0)
    got = knn_tree.knn_by_tree(query, ref, k, True, 4096, pairs).toPandas()
    compared = pairs.value  # read before another action runs the tasks again
    assert len(got) == m * k and compared < 0.05 * n * m
    held = ref.toArrow()
    R, rk = knn_tree.matrix(held["vec"]), held["key"].to_numpy()
    for key in got["key"].unique()[::200]:
        own = R[rk == key][0]
        d = np.sqrt(((R - own) ** 2).sum(1))
        d[rk == key] = np.inf
        at = np.lexsort((rk, d))[:k]
        mine = got[got["key"] == key].sort_values("rank")
        assert mine["neighbour"].tolist() == rk[at].tolist() and np.allclose(mine["distance"], d[at])


def test_smote_on_segments_and_counts(spark):
    df, X = _vecs(spark)
    syn = resample.smote_samples(df, 5, 7).collect()
    n_min = int((np.arange(300) % 9 == 0).sum())
    assert len(syn) == 300 - 2 * n_min
    for r in syn[:50]:
        p, a, b = np.array(r["vec"]), X[r["base_key"]], X[r["neighbour_key"]]
        assert np.allclose(p, a + r["gap"] * (b - a))
    sm = resample.smote(df, 5, 7).groupBy("y").count().collect()
    assert len({r["count"] for r in sm}) == 1  # balanced


def test_split_and_folds(spark):
    df, _ = _vecs(spark, 500)
    sp = sampling.stratified_split(df, "key", "y", 0.2, 1)
    c = {(r["split"], r["y"]): r["count"] for r in sp.groupBy("split", "y").count().collect()}
    assert c[("test", 0)] + c[("test", 1)] == 100
    assert abs(c[("test", 1)] / 100 - 56 / 500) < 0.02
    f = sampling.stratified_folds(df, "key", "y", 3, 1).groupBy("y", "fold").count().collect()
    by = {}
    for r in f:
        by.setdefault(r["y"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in by.values())


def test_adasyn_hot_row_chunks(spark):
    """A tiny chunk size forces many chunks per base row; result equals the one-chunk run."""
    df, _ = _vecs(spark, 400, 6, 2)
    a = resample.adasyn_samples(df, 5, 3).select("base_key", "s", "neighbour_key", "gap").collect()
    b = resample.adasyn_samples(df, 5, 3, chunk=2).select("base_key", "s", "neighbour_key", "gap").collect()
    key = lambda r: (r["base_key"], r["s"])
    assert sorted(a, key=key) == sorted(b, key=key) and len(a) > 0


def test_adasyn_keys_are_unique_for_a_hot_row(spark):
    """Two hard minority rows own thousands of synthetic rows each."""
    rows = [(i, 0, [float(i % 50), float(i // 50) + 100.0]) for i in range(6000)]
    rows += [(1 << 41, 1, [0.2, 100.2]), ((1 << 41) + 1, 1, [3.2, 103.1])]
    rows += [(7000 + k, 1, [-500.0 - k % 3, -500.0 - k // 3]) for k in range(12)]  # easy: all neighbours are minority
    df = spark.createDataFrame(rows, "key long, y int, vec array<double>")
    out = resample.adasyn(df, 5, 3)
    syn = out.where("is_synthetic")
    n = syn.count()
    assert n > 5000 and out.select("key").distinct().count() == n + len(rows)
    assert syn.agg(F.min("key")).first()[0] > (1 << 41) + 1


def test_smote_keys_follow_large_source_keys(spark):
    df, _ = _vecs(spark)
    big = df.withColumn("key", F.col("key") + F.lit(1 << 40))
    out = resample.smote(big, 5, 7)
    assert out.count() == out.select("key").distinct().count()


def test_too_few_minority_rows(spark):
    df, _ = _vecs(spark, 60)
    few = df.where("y = 0").unionByName(df.where("y = 1").limit(5))
    for build in (resample.smote, resample.adasyn):
        with pytest.raises(ValueError, match="minority"):
            build(few, 5, 1)
    errors = {}
    sets = resample.balanced_datasets(few, 5, 1, errors=errors)
    assert "SMOTE" in errors and "SMOTE" not in sets


def test_thresholds_equal_ranks(spark):
    df = spark.range(5000).select(F.col("id").alias("c") % 2, (F.col("id") * 7919 % 5000 / 5000.0).alias("u"), F.col("id").alias("key"))
    df = df.toDF("c", "u", "key")
    rows = df.collect()
    for q in (1, 17, 1234, 2500):
        got = sampling.draw_thresholds(df, {0: q, 1: q})
        for c in (0, 1):
            assert got[c] == sorted((r["u"], r["key"]) for r in rows if r["c"] == c)[q - 1]


def test_axes_tell_pairs_apart(spark):
    """Rows that few axes tell apart are sifted along these: the pairs within the bound are those of the plain product, and few others are left."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3000, 8)) @ rng.normal(size=(8, 60)) * 3 + rng.normal(size=(3000, 60)) * 0.01
    base[:40] *= 50.0  # some far out
    Q, k = base[::7], 3
    d = np.sqrt(((Q[:, None] - base[None]) ** 2).sum(2))
    bound = np.sort(d, axis=1)[:, k - 1]
    left = knn_tree.sifted(Q, bound * (1 + 1e-9), base)
    assert left is not None and len(left[0]) <= len(Q) * len(base) // knn_tree.SIFT
    row, at, distance = knn_tree.within_bound(Q, bound, base, k)
    assert set(zip(*(x.tolist() for x in np.nonzero(d <= bound[:, None])))) <= set(zip(row.tolist(), at.tolist()))
    assert knn_tree.sifted(rng.normal(size=(500, 64)), np.full(500, 8.0), rng.normal(size=(500, 64))) is None


def test_vectors_are_dealt_to_few_leaves(spark, monkeypatch):
    """However many leaves there are, a row is dealt to a bounded number of them; those with more open leaves meet blocks, in
    which only the leaves within reach are compared."""
    visits, plain = [], knn_tree.write_shared

    def seen(df, name):
        out = plain(df, name)
        if name == "knn-round":
            visits.append(out.agg(F.max(F.size("visited"))).first()[0] or 0)
        return out

    monkeypatch.setattr(knn_tree, "write_shared", seen)
    monkeypatch.setattr(knn_tree, "NEAR_LEAVES", 2)
    monkeypatch.setattr(knn_tree, "BLOCK_BYTES", 200 * 8 * 3)
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rng.uniform(size=(3000, 3)).tolist())], "key long, vec array<double>")
    counted = spark.sparkContext.accumulator(0)
    _same(knn.knn(df, df, 8), knn_tree.knn_by_tree(df, df, 8, True, 20, counted))
    assert max(visits) <= 12
    assert counted.value < 3000 * 3000 // 3
