"""Zoo runner (F23): every model on every balanced training set, scored on
the test split, metrics for all runs in one aggregation.

A driver loop submits Spark ML jobs (a small thread pool runs a few fits at
once, more of them where a set is a few tasks only; Spark schedules their tasks on the executors). Entries of equal estimator and
training set share one fit. Each fit's test scores are written to its own partition of
one table in the shared folder (they are test-sized), so the metric job never refits and reads one
table. Failed fits are recorded with ``status='error: ...'`` instead of stopping the
run (S19).
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, sampling
from ..operators.resample import balanced_datasets
from ..operators.stats import balanced_weights
from ..session import shared_path, write_shared
from .registry import REGISTRY, FitContext, FittedModel, ModelSizes, ModelSpec

LEADERBOARD_COLUMNS = [
    "experiment", "run_id", "nombre", "modelo_base", "categoria", "tipo_dataset",
    "precision", "recall", "f1", "roc_auc", "pr_auc", "status",
]


def fit_array_scaler(df: DataFrame, vec: str = "vec") -> tuple[list[float], list[float]]:
    """Mean and population std of every vector position (S11: std 0 -> 1).
    One aggregate; d means and deviations come back."""
    row = df.select(array_to_vector(vec).alias("v")).select(
        Summarizer.metrics("mean", "std", "count").summary(F.col("v")).alias("s")).first()["s"]
    n = row["count"]
    shrink = ((n - 1) / n) ** 0.5 if n > 1 else 0.0  # sample to population deviation
    return [float(x) for x in row["mean"]], [float(x) * shrink or 1.0 for x in row["std"]]


def apply_array_scaler(df: DataFrame, params, vec: str = "vec") -> DataFrame:
    m, s = params
    ma, sa = F.array(*[F.lit(x) for x in m]), F.array(*[F.lit(x) for x in s])
    return df.withColumn(vec, F.transform(vec, lambda x, i: (x - F.element_at(ma, i + 1)) / F.element_at(sa, i + 1)))


def to_ml(df: DataFrame, key: str = "key", y: str = "y", vec: str = "vec") -> DataFrame:
    """(key, label, weight, features) with balanced class weights."""
    base = df.select(F.col(key).alias("key"), F.col(y).cast("double").alias("label"), F.col(vec).alias("vec"))
    return balanced_weights(base, "label").select(
        "key", "label", "weight", array_to_vector("vec").alias("features")
    )


CELLS = 1_000_000  # numbers of a training set that are worth a task
FITS, MOST_FITS = 4, 16  # fits at once: at least, and where the sets are small


def few_tasks(ml: DataFrame, rows: int, n_features: int) -> DataFrame:
    """``ml`` in no more tasks than its size is worth: a fit is thousands of short jobs over it."""
    tasks = max(1, -(-rows * n_features // CELLS))
    return ml if ml.rdd.getNumPartitions() <= tasks else write_shared(ml.coalesce(tasks), "zoo-set")


def fits_at_once(sets: list[DataFrame]) -> int:
    """As many fits as have a core for each task of the largest set, within FITS and MOST_FITS."""
    tasks = max((ml.rdd.getNumPartitions() for ml in sets), default=1)
    cores = sets[0].sparkSession.sparkContext.defaultParallelism if sets else 1
    return max(FITS, min(MOST_FITS, cores // max(1, tasks)))


@dataclass
class ZooData:
    train: DataFrame
    test: DataFrame
    datasets: dict[str, DataFrame]
    n_features: int
    errors: dict | None = None


def zoo_data(rows: DataFrame, seed: int = 42, test_size: float = 0.2, k: int = 5, datasets: Sequence[str] | None = None) -> ZooData:
    """Stratified split, scaler fitted on train, the five balanced sets (or those named)."""
    sp = write_shared(sampling.stratified_split(rows, "key", "y", test_size, seed), "split")
    train = sp.where(F.col("split") == "train").drop("split")
    test = sp.where(F.col("split") == "test").drop("split")
    params = fit_array_scaler(train)
    train, test = apply_array_scaler(train, params), apply_array_scaler(test, params)
    errors: dict = {}
    sets = balanced_datasets(train, k, seed, errors=errors, names=datasets)
    return ZooData(train, test, sets, len(params[0]), errors)


@dataclass
class Zoo:
    """``scores``: run_id, key, score, y, pred over the test rows; ``models`` by run_id; ``fits``: how many were fitted."""

    leaderboard: DataFrame
    scores: DataFrame
    models: dict[int, FittedModel]
    fits: int = 0


def run_zoo(data: ZooData, models: list[ModelSpec] | None = None, sizes: ModelSizes | None = None, seed: int = 73,
            experiment: str = "zoo", parallelism: int | None = None, dataset_names: list[str] | None = None) -> Zoo:
    """Fit every model (by default all 25, at the reference's sizes) on every balanced set, ``parallelism`` fits at a
    time (by default after the sets' size, see ``fits_at_once``)."""
    models = models or REGISTRY
    spark = data.train.sparkSession
    test_ml = write_shared(to_ml(data.test), "zoo-test")
    n0, n1 = 0, 0
    for r in data.train.groupBy("y").count().collect():
        n0, n1 = (r["count"], n1) if r["y"] == 0 else (n0, r["count"])
    runs, fits, prepared, run_id = [], {}, {}, 0  # fits: (set, entry that is fitted) to its number
    for ds_name, ds in data.datasets.items():
        if dataset_names is not None and ds_name not in dataset_names:
            continue
        ml = write_shared(to_ml(ds), "zoo-set")
        n = ml.count()
        prepared[ds_name] = (few_tasks(ml, n, data.n_features), n)
        for m in models:
            run_id += 1
            runs.append((run_id, ds_name, m, fits.setdefault((ds_name, m.fits_as or m.name), len(fits))))
    specs = {fit: (ds_name, m) for _, ds_name, m, fit in reversed(runs)}
    base = shared_path(spark, "zoo-scores")

    def one(fit):
        ds_name, m = specs[fit]
        ml, n = prepared[ds_name]
        ctx = FitContext(n_train=n, n_features=data.n_features, scale_pos_weight=(n0 / n1) if n1 else 1.0,
                         seed=seed, sizes=sizes or ModelSizes())
        try:
            fitted = m.build(ctx)(ml)
            fitted.transform(test_ml).select(
                "key", F.col("score").cast("double"), F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"),
            ).write.mode("overwrite").parquet(f"{base}/fit={fit}")
            return "ok", fitted
        except Exception as e:  # noqa: BLE001 - a failed fit is a result row (S19)
            return f"error: {type(e).__name__}: {e}", None

    order = sorted(specs, key=lambda fit: not specs[fit][1].long)  # the longest first, so that none of them ends alone
    if parallelism is None:
        parallelism = fits_at_once([ml for ml, _ in prepared.values()])
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        fitted = dict(zip(order, pool.map(one, order)))
    done = [(rid, ds_name, m, *fitted[fit], fit) for rid, ds_name, m, fit in runs]
    rows = [(experiment, rid, f"{m.name}_{ds}", m.name, m.categoria, ds, status) for rid, ds, m, status, *_ in done]
    for ds_name, msg in (data.errors or {}).items():  # a set that could not be built: one error row per model
        for m in models:
            run_id += 1
            rows.append((experiment, run_id, f"{m.name}_{ds_name}", m.name, m.categoria, ds_name,
                         f"error: {msg}"))
    info = spark.createDataFrame(
        rows, "experiment string, run_id bigint, nombre string, modelo_base string, categoria string, "
              "tipo_dataset string, status string"
    )
    good = [(rid, fit) for rid, _, _, status, _, fit in done if status == "ok"]
    if not good:
        empty = spark.createDataFrame([], "run_id bigint, key long, score double, y int, pred int")
        lb = info.select(*[c if c in info.columns else F.lit(None).cast("double").alias(c) for c in LEADERBOARD_COLUMNS])
        return Zoo(lb, empty, {})
    key_type = test_ml.schema["key"].dataType.simpleString()
    table = spark.read.schema(f"key {key_type}, score double, y int, pred int, fit int").option("basePath", base).parquet(
        *(f"{base}/fit={fit}" for fit in sorted({fit for _, fit in good})))
    of_fit = F.broadcast(spark.createDataFrame(good, "run_id bigint, fit int"))  # one row a run
    scores = table.join(of_fit, "fit").select("run_id", "key", "score", "y", "pred")
    mets = metrics.all_metrics(scores, ["run_id"], "score", "y", "pred")
    lb = info.join(mets, "run_id", "left").select(*LEADERBOARD_COLUMNS)
    return Zoo(lb, scores, {rid: model for rid, _, _, _, model, _ in done if model is not None}, len(specs))
