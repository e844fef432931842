"""The three stages on a user's own file: read, prepare, train, pick, rank, save and reload a pick."""

import os
import subprocess
import sys
import uuid

import pytest
from pyspark.sql import functions as F

from dialsift.config import RunConfig
from dialsift.models.registry import FittedModel, ModelSizes
from dialsift.models.runner import to_ml
from dialsift.plans.evaluate import evaluate
from dialsift.operators.ranking import improvement_80
from dialsift.plans.prepare import prepare
from dialsift.sources.attempts import attempts
from dialsift.sources.delimited import read_delimited, read_inferred, write_delimited

from .conftest import SF001

SIZES = ModelSizes(trees=5, depth=3, rounds=3, iterations=20)
SPACES = {"RandomForest": {"numTrees": (3, 5), "maxDepth": (2, 3)}}


def _file(spark):
    src = attempts(spark, SF001)
    path = os.path.join(spark.sparkContext.getCheckpointDir(), f"own-{uuid.uuid4().hex}")
    write_delimited(src, path)
    return read_delimited(spark, path, src.schema)


def test_file_to_tuned_ranking_and_saved_pick(spark):
    models = ["Linear_LogisticRegression", "Ensemble_RandomForest", "NaiveBayes_GaussianNB"]
    ev = evaluate(_file(spark), RunConfig(tuning_iter=2), models=models, dataset_names=["Original", "Undersampling"], sizes=SIZES,
                  tuned=True, spaces=SPACES)
    assert {r["estrategia"] for r in ev.scores.select("estrategia").distinct().collect()} >= {"Balanceado", "Alto_Recall", "Conservador"}
    assert set(ev.tuned.columns) >= {"mejora_f1", "mejora_recall", "mejora_precision", "mejores_params"}
    model = ev.models["Balanceado"]
    path = os.path.join(spark.sparkContext.getCheckpointDir(), f"pick-{uuid.uuid4().hex}")
    model.save(path)
    rows = ev.prepared.data.select(F.col("CODIGO").alias("key"), F.col("CD").alias("y"),
                                   F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ev.prepared.features]).alias("vec"))
    ml = to_ml(rows)
    score = lambda m: {r["key"]: r["score"] for r in m.transform(ml).select("key", "score").collect()}
    assert score(FittedModel.load(spark, path)) == score(model)


def test_fit_on_train_and_feature_switch(spark):
    src = attempts(spark, SF001)
    plain = prepare(src, RunConfig(feature_types=()))
    assert plain.created == [] and len(plain.features) > 5
    on_train = prepare(src, RunConfig(fit_on="train", feature_types=("ratio",)))
    assert on_train.created and on_train.data.count() == src.count()
    with pytest.raises(ValueError):
        prepare(src, RunConfig(fit_on="test"))


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as E
print("ROWS", E.queries()["knn_exact"](spark, {data!r}).count())
"""


def test_queries_run_from_another_folder(tmp_path):
    """Workers get the package from the driver, not from their working folder."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, data=SF001)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 2500" in out.stdout, out.stderr[-2000:]


def test_bare_file_to_a_ranked_pipeline_of_the_users_own(spark):
    """A pipe file without a schema, a user's Spark ML pipeline beside a zoo entry: compared, picked, ranked, saved, reloaded."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import PCA

    path = os.path.join(spark.sparkContext.getCheckpointDir(), f"bare-{uuid.uuid4().hex}")
    write_delimited(attempts(spark, SF001), path)
    mine = Pipeline(stages=[PCA(k=5, inputCol="features", outputCol="pca"), LogisticRegression(featuresCol="pca", labelCol="label", maxIter=20)])
    ev = evaluate(read_inferred(spark, path), RunConfig(tuning_iter=2), models={"mine": mine, "also": LogisticRegression(labelCol="label", maxIter=10)},
                  dataset_names=["Undersampling"], tuned=True)
    assert {r["modelo_base"]: r["status"] for r in ev.leaderboard.collect()} == {"mine": "ok", "also": "ok"}
    assert {r["tuneado"] for r in ev.tuned.collect()} == {False}
    ranked = {r["Estrategia"] for r in improvement_80(ev.scores).collect()}
    assert "Balanceado" in ranked
    model = next(iter(ev.models.values()))
    folder = os.path.join(spark.sparkContext.getCheckpointDir(), f"own-{uuid.uuid4().hex}")
    model.save(folder)
    rows = ev.prepared.data.select(F.col("CODIGO").alias("key"), F.col("CD").alias("y"),
                                   F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ev.prepared.features]).alias("vec"))
    ml = to_ml(rows)
    score = lambda m: {r["key"]: r["score"] for r in m.transform(ml).select("key", "score").collect()}
    assert score(FittedModel.load(spark, folder)) == score(model)
