"""The join that splits hot keys, and components by it."""

import random

import pytest

from dialsift.llm import common
from dialsift.llm.components import components


@pytest.mark.parametrize("hot_keys", [1000, 3, 0])  # all keys are hot; one is; none is
@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join_equals_join(spark, monkeypatch, hot_keys, how):
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    keys = [7] * 60 + [k % 9 for k in range(60)]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i int")
    named = spark.createDataFrame([(k, f"name {k}", keys.count(k)) for k in (1, 2, 7)], "k long, name string, n long")
    got = common.hot_join(rows, named, ["k"], len(keys), how)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.join(named, "k", how).collect()), key=str)


def test_a_hot_key_is_not_shuffled(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id < 3000 THEN -1 ELSE id END AS k", "id")
    named = rows.groupBy("k").count().withColumnRenamed("count", "n")
    few = named.filter(f"n * {common.HOT_KEYS} > 5000").collect()
    assert [tuple(r) for r in few] == [(-1, 3000)]
    assert common.hot_join(rows, named, ["k"], 5000).count() == 5000


@pytest.mark.parametrize("hot_keys", [1000, 3, 0])
def test_components_with_a_hub(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    rnd = random.Random(2)
    edges = [(500, k) for k in range(501, 700)] + [(k, k + 1) for k in range(40)] + [(rnd.randrange(800, 900), rnd.randrange(800, 900)) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r["node"], r["root"]) for r in got) == sorted((x, find(x)) for x in root)
