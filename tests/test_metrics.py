"""AUC / AP on the six-row example, tie handling, symmetry, zero division."""

import math
import random

from pyspark.sql import functions as F

from dialsift.operators import metrics


def test_auc_six(spark):
    rows = [("r", i, s, y, int(s >= 0.5)) for i, (s, y) in enumerate(zip([.9, .8, .8, .4, .3, .1], [1, 0, 1, 0, 1, 0]))]
    df = spark.createDataFrame(rows, "run string, key long, score double, y int, pred int")
    m = metrics.all_metrics(df).first()
    assert math.isclose(m["roc_auc"], 0.7222222222, rel_tol=1e-9)
    assert math.isclose(m["pr_auc"], 0.7555555556, rel_tol=1e-9)
    assert math.isclose(m["precision"], 2 / 3) and math.isclose(m["recall"], 2 / 3)


def test_auc_symmetry_and_one_class(spark):
    rnd = random.Random(5)
    rows = [("a", i, float(rnd.randint(0, 9)), int(rnd.random() < 0.3), 0) for i in range(500)]
    rows += [("b", 1000 + i, float(i), 1, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "run string, key long, score double, y int, pred int")
    pos = {r["run"]: r["roc_auc"] for r in metrics.roc_auc(df).collect()}
    neg = {r["run"]: r["roc_auc"] for r in metrics.roc_auc(df.withColumn("score", -F.col("score"))).collect()}
    assert math.isclose(pos["a"] + neg["a"], 1.0)
    assert pos["b"] is None  # one class only
    cm = {r["run"]: r for r in metrics.classification_metrics(df).collect()}
    assert cm["a"]["precision"] == 0.0 and cm["a"]["f1"] == 0.0  # zero division -> 0


def test_recall_min_precision(spark):
    df = spark.createDataFrame([(0.10, 0.8), (0.2, 0.5)], "precision double, recall double")
    r = [x["recall_min_precision"] for x in metrics.recall_with_min_precision(df, 0.15).collect()]
    assert math.isclose(r[0], 0.8 - 0.1) and r[1] == 0.5
