"""The model zoo (F1-F22) as Spark ML jobs.

Every entry builds a fitter ``fit(train) -> FittedModel`` where ``train`` has
``key, label, weight, features`` (``features`` a VectorUDT). Fits are distributed Spark ML
jobs; the few closed forms (LDA/QDA, SAMME weights) aggregate moments on the
executors and solve a d×d system on the driver.

Fidelity to the reference's scikit-learn models is stated per entry:
Exact = same objective; Family = same model class, other optimiser or
defaults; Approx = nearest Spark construction.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import Binarizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_shared
from .forest import BalancedSamples, Grown, grow_forest, score_udf
from .linear import fit_squared_hinge


@dataclass(frozen=True)
class ModelSizes:
    """Upper limits on the sizes of the zoo's models. ``None`` is the reference's
    size; a caller that wants a shorter run passes its limits explicitly."""

    trees: int | None = None
    depth: int | None = None
    rounds: int | None = None
    iterations: int | None = None

    def limit(self, kind: str, full: int) -> int:
        most = getattr(self, kind)
        return full if most is None else min(full, most)


@dataclass
class FitContext:
    n_train: int
    n_features: int
    scale_pos_weight: float
    seed: int = 73
    sizes: ModelSizes = field(default_factory=ModelSizes)

    def size(self, kind: str, full: int) -> int:
        return self.sizes.limit(kind, full)


@dataclass
class FittedModel:
    """A fitted zoo model: Spark ML parts, plain parameters and, for kNN, its training table.

    ``transform(df)`` adds ``score`` (probability of class 1, else the decision
    value, else the label, F24) and ``prediction``; ``save``/``load`` keep it in a folder."""

    kind: str
    models: list = field(default_factory=list)
    params: dict = field(default_factory=dict)
    table: DataFrame | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        return SCORERS[self.kind](self, df)

    __call__ = transform

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        meta = json.dumps({"kind": self.kind, "params": self.params, "models": len(self.models), "table": self.table is not None})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.text(f"{path}/meta")
        for k, m in enumerate(self.models):
            m.save(f"{path}/model-{k}")
        if self.table is not None:
            self.table.write.parquet(f"{path}/table")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedModel:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        models = [DefaultParamsReader.loadParamsInstance(f"{path}/model-{k}", spark) for k in range(meta["models"])]
        return cls(meta["kind"], models, meta["params"], spark.read.parquet(f"{path}/table") if meta["table"] else None)


@dataclass
class ModelSpec:
    """``fits_as`` names the entry whose fit this one shares: the same estimator with the same parameters and seed.
    A ``long`` fit is rounds that follow each other."""

    name: str
    categoria: str
    build: Callable[[FitContext], Callable[[DataFrame], FittedModel]]
    fidelity: str = "Family"
    fits_as: str | None = None
    long: bool = False


def user_model(name: str, estimator, categoria: str = "User", weighted: bool = False) -> ModelSpec:
    """A user's Spark ML estimator, pipeline, or fitted model as an entry of the zoo. It sees columns
    ``label`` (0/1), ``features`` (vector), ``weight`` (balanced class weights) and ``key``; an estimator is fitted on
    each training set, a fitted model only scores. Its score is the probability of class 1, else the raw
    prediction, else the label (F24). ``weighted`` sets the estimator's ``weightCol``."""

    def build(ctx: FitContext):
        def fit(train: DataFrame) -> FittedModel:
            if not hasattr(estimator, "fit"):
                return fitted_ml(estimator)
            return fitted_ml((estimator.copy().setWeightCol("weight") if weighted else estimator).fit(train))

        return fit

    return ModelSpec(name, categoria, build, "User")


def _score_ml(fitted: FittedModel, df: DataFrame) -> DataFrame:
    """probability[1] -> rawPrediction[1] -> prediction."""
    out = fitted.models[0].transform(df)
    cols = set(out.columns)
    if fitted.params.get("has_prob", True) and "probability" in cols:
        s = vector_to_array("probability")[1]
    elif "rawPrediction" in cols:
        s = vector_to_array("rawPrediction")[1]
    else:
        s = F.col("prediction")
    return out.withColumn("score", s.cast("double")).withColumn("prediction", F.col("prediction").cast("int"))


def fitted_ml(model, has_prob: bool = True) -> FittedModel:
    return FittedModel("ml", [model], {"has_prob": has_prob})


def _ml(est_factory, weighted: bool = False, has_prob: bool = True):
    def build(ctx: FitContext):
        def fit(train: DataFrame) -> FittedModel:
            est = est_factory(ctx)
            if weighted:
                est = est.setWeightCol("weight")
            return fitted_ml(est.fit(train), has_prob)

        return fit

    return build


# ---------------------------------------------------------------- custom fitters


def _ridge(ctx: FitContext):
    """F3 RidgeClassifier(alpha=1, balanced): weighted least squares on ±1
    labels; Spark's objective 1/(2n)·Σw(y-xb)² + λ/2|b|² equals sklearn's with
    λ = 1/n. Score = decision value, class = score > 0. Exact."""

    def fit(train: DataFrame) -> FittedModel:
        t = train.withColumn("_pm", F.col("label") * F.lit(2.0) - F.lit(1.0))
        m = LinearRegression(featuresCol="features", labelCol="_pm", weightCol="weight",
                             regParam=1.0 / max(1, ctx.n_train), elasticNetParam=0.0, standardization=False,
                             solver="normal").fit(t)

        return FittedModel("decision", [m])

    return fit


def _score_decision(fitted: FittedModel, df: DataFrame) -> DataFrame:
    out = fitted.models[0].transform(df).withColumnRenamed("prediction", "score")
    return out.withColumn("prediction", (F.col("score") > 0).cast("int"))


def _platt_svc(ctx: FitContext):
    """F8 SVC(kernel='linear', probability=True): linear SVM margin calibrated
    by a one-feature logistic regression (Platt scaling). Family."""

    def fit(train: DataFrame) -> FittedModel:
        svm = LinearSVC(featuresCol="features", labelCol="label", weightCol="weight", standardization=False,
                        regParam=1.0 / max(1, ctx.n_train), maxIter=ctx.size("iterations", 1000)).fit(train)
        margin = svm.transform(train).select("label", _margin_vector())
        cal = LogisticRegression(featuresCol="_mf", labelCol="label", maxIter=100).fit(margin)
        return FittedModel("platt", [svm, cal])

    return fit


MLP_ROUND = 5  # iterations between two looks at the held-out rows
MLP_PATIENCE = 10  # rounds without progress
MLP_PROGRESS = 1e-4


def _mlp(*hidden: int):
    """F21 MLPClassifier(early_stopping=True, validation_fraction=0.1): training goes on from the last weights in
    rounds of a few iterations until the accuracy on a stratified held-out tenth has not risen for
    MLP_PATIENCE rounds; the weights of the best round are kept. Family (L-BFGS instead of Adam)."""

    def build(ctx: FitContext):
        def fit(train: DataFrame) -> FittedModel:
            from ..operators.sampling import stratified_split

            parts = write_shared(stratified_split(train, "key", "label", 0.1, ctx.seed), "mlp")
            own, held = (parts.where(F.col("split") == side).drop("split") for side in ("train", "test"))
            best, kept, weights, waited, rounds = -1.0, None, None, 0, 0
            while rounds * MLP_ROUND < ctx.size("iterations", 200) and waited < MLP_PATIENCE:
                est = MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=[ctx.n_features, *hidden, 2],
                                                     maxIter=MLP_ROUND, seed=ctx.seed)
                model = (est if weights is None else est.setInitialWeights(weights)).fit(own)
                accuracy = model.transform(held).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a")).first()["a"] or 0.0
                waited = 0 if accuracy > best + MLP_PROGRESS else waited + 1
                if accuracy > best:
                    best, kept = accuracy, model
                weights, rounds = model.weights, rounds + 1
            return FittedModel("ml", [kept], {"has_prob": True, "rounds": rounds, "held_out_accuracy": best})

        return fit

    return build


def _squared_hinge(ctx: FitContext):
    """F7 LinearSVC(dual=False): squared hinge, C=1, balanced, intercept penalised. Score = decision value. Exact."""

    def fit(train: DataFrame) -> FittedModel:
        w = fit_squared_hinge(train, ctx.n_features, max_steps=ctx.size("iterations", 1000))
        return FittedModel("margin", params={"w": w[:-1].tolist(), "b": float(w[-1])})

    return fit


def _score_margin(fitted: FittedModel, df: DataFrame) -> DataFrame:
    weights = F.array(*[F.lit(x) for x in fitted.params["w"]])
    products = F.zip_with(vector_to_array("features"), weights, lambda x, w: x * w)
    out = df.withColumn("score", F.aggregate(products, F.lit(fitted.params["b"]), lambda a, x: a + x))
    return out.withColumn("prediction", (F.col("score") > 0).cast("int"))


def _margin_vector():
    return array_to_vector(F.array(vector_to_array("rawPrediction")[1])).alias("_mf")


def _score_platt(fitted: FittedModel, df: DataFrame) -> DataFrame:
    svm, cal = fitted.models
    out = svm.transform(df).withColumn("_mf", _margin_vector()).drop("probability", "prediction", "rawPrediction")
    out = cal.transform(out)
    return out.withColumn("score", vector_to_array("probability")[1]).withColumn("prediction", F.col("prediction").cast("int"))


def class_moments(train: DataFrame, d: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class: n, Σx, Σxxᵀ. Each task reduces its Arrow batches to
    1 + d + d² numbers per class, emitted as (class, slot, value) rows; a
    groupBy on (class, slot) sums them on the executors (map-side combined),
    so only classes × (1 + d + d²) numbers reach the driver whatever the
    number of tasks."""
    arr = train.select(F.col("label").cast("int").alias("c"), vector_to_array("features").alias("x"))

    def part(batches):
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            for c, grp in b.groupby("c"):
                X = np.stack(grp["x"].to_numpy()).astype(np.float64)
                v = np.concatenate([[len(X)], X.sum(0), (X.T @ X).ravel()])
                acc[int(c)] = acc[int(c)] + v if int(c) in acc else v
        for c, v in acc.items():
            yield pd.DataFrame({"c": np.full(len(v), c, dtype=np.int32), "slot": np.arange(len(v), dtype=np.int32),
                                "v": v})

    sums = arr.mapInPandas(part, "c int, slot int, v double").groupBy("c", "slot").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in sums.collect():  # classes × (1 + d + d²) rows
        out.setdefault(r["c"], np.zeros(1 + d + d * d))[r["slot"]] = r["v"]
    return {c: (v[0], v[1:1 + d], v[1 + d:].reshape(d, d)) for c, v in out.items()}


def _discriminant(quadratic: bool):
    """F5 LinearDiscriminantAnalysis / F6 QuadraticDiscriminantAnalysis in
    closed form from class moments; posterior of class 1 scored per Arrow
    batch. Exact (up to the covariance regulariser 1e-9·I)."""

    def build(ctx: FitContext):
        def fit(train: DataFrame) -> FittedModel:
            d = ctx.n_features
            mom = class_moments(train, d)
            n0, s0, ss0 = mom.get(0, (0.0, np.zeros(d), np.zeros((d, d))))
            n1, s1, ss1 = mom.get(1, (0.0, np.zeros(d), np.zeros((d, d))))
            if n0 == 0 or n1 == 0:
                raise ValueError("discriminant analysis needs both classes")
            m0, m1 = s0 / n0, s1 / n1
            c0 = ss0 - n0 * np.outer(m0, m0)
            c1 = ss1 - n1 * np.outer(m1, m1)
            prior = math.log(n1 / n0)
            eye = 1e-9 * np.eye(d)
            if not quadratic:
                cov = (c0 + c1) / max(1.0, n0 + n1 - 2) + eye
                w = np.linalg.solve(cov, m1 - m0)
                b = -0.5 * float((m1 + m0) @ w) + prior
                return FittedModel("discriminant", params={"w": w.tolist(), "b": b})
            k0 = c0 / max(1.0, n0 - 1) + eye
            k1 = c1 / max(1.0, n1 - 1) + eye
            ld = np.linalg.slogdet(k0)[1] - np.linalg.slogdet(k1)[1]
            return FittedModel("discriminant", params={
                "m0": m0.tolist(), "m1": m1.tolist(), "i0": np.linalg.inv(k0).tolist(), "i1": np.linalg.inv(k1).tolist(),
                "c": float(0.5 * ld + prior)})

        return fit

    return build


def _score_discriminant(fitted: FittedModel, df: DataFrame) -> DataFrame:
    ref = df.sparkSession.sparkContext.broadcast({k: np.asarray(v) for k, v in fitted.params.items()})  # d x d numbers

    @F.pandas_udf(T.DoubleType())
    def posterior(x: pd.Series) -> pd.Series:
        p = ref.value
        if not len(x):
            return pd.Series([], dtype="float64")
        X = np.stack(x.to_numpy()).astype(np.float64)
        if "w" in p:
            z = X @ p["w"] + p["b"]
        else:
            a0, a1 = X - p["m0"], X - p["m1"]
            z = 0.5 * ((a0 @ p["i0"]) * a0).sum(1) - 0.5 * ((a1 @ p["i1"]) * a1).sum(1) + p["c"]
        return pd.Series(1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))))

    out = df.withColumn("score", posterior(vector_to_array("features")))
    return out.withColumn("prediction", (F.col("score") > 0.5).cast("int"))


def _knn_model(k: int):
    """F9 KNeighborsClassifier(k): exact kNN of each scored row among the
    training rows (E4); score = share of positive neighbours. Exact."""

    def build(ctx: FitContext):
        def fit(train: DataFrame) -> FittedModel:
            return FittedModel("knn", params={"k": k}, table=train.select("key", vector_to_array("features").alias("vec"), "label"))

        return fit

    return build


def _score_knn(fitted: FittedModel, df: DataFrame) -> DataFrame:
    from ..operators.knn import knn

    q = df.select("key", vector_to_array("features").alias("vec"))
    nn = knn(q, fitted.table, fitted.params["k"], exclude_self=False)
    s = nn.join(fitted.table.select(F.col("key").alias("neighbour"), "label"), "neighbour").groupBy("key").agg(F.avg("label").alias("score"))
    return df.join(s, "key", "left").withColumn("prediction", (F.col("score") > 0.5).cast("int"))


def _adaboost(ctx: FitContext):
    """F15 AdaBoost(SAMME) over depth-1 trees: each round one weighted Spark
    stump fit, whose leaves' class weights give the weighted error, and a column update of the
    weights, which are written to the shared folder every 5 rounds so that a round
    recomputes few projections. Stops at error 0 or >= 0.5. Exact algorithm."""

    def fit(train: DataFrame) -> FittedModel:
        rounds = ctx.size("rounds", 200)
        cur = train.withColumn("_w", F.lit(1.0) / F.lit(float(ctx.n_train)))
        stumps: list[tuple[float, object]] = []
        for t in range(rounds):
            st = DecisionTreeClassifier(featuresCol="features", labelCol="label", weightCol="_w", maxDepth=1,
                                        seed=ctx.seed + t).fit(cur)
            missed, weight = _missed_weight(st)
            err = missed / weight if weight else 0.0
            if err <= 0:
                stumps.append((1.0, st))
                break
            if err >= 0.5:
                break
            alpha = math.log((1 - err) / err)
            stumps.append((alpha, st))
            miss = (_stump_side(vector_to_array("features"), *_stump(st)) != F.col("label")).cast("double")
            cur = cur.select(*train.columns, (F.col("_w") * F.exp(F.lit(alpha) * miss)).alias("_w"))
            if (t + 1) % 5 == 0:
                cur = write_shared(cur, "adaboost")
        if not stumps:
            raise ValueError("AdaBoost: first stump already has error >= 0.5")

        return FittedModel("stumps", [st for _, st in stumps], {"alphas": [a for a, _ in stumps]})

    return fit


def _stump(model) -> tuple[int, float, float, float]:
    """Feature, cut and the classes at or below and above it of a fitted tree of depth 1."""
    root = model._java_obj.rootNode()
    if root.subtreeDepth() == 0:
        return 0, math.inf, root.prediction(), root.prediction()
    return root.split().featureIndex(), root.split().threshold(), root.leftChild().prediction(), root.rightChild().prediction()


def _missed_weight(model) -> tuple[float, float]:
    """Weight of the training rows that a fitted tree of depth 1 gives the wrong class, and of all."""
    root = model._java_obj.rootNode()
    leaves = [root] if root.subtreeDepth() == 0 else [root.leftChild(), root.rightChild()]
    stats = [(int(leaf.prediction()), list(leaf.impurityStats().stats())) for leaf in leaves]
    return sum(sum(w[:c] + w[c + 1:]) for c, w in stats), sum(sum(w) for _, w in stats)


def _stump_side(x, feature, cut, below, above):
    """The class that a stump gives to the vector ``x``, from numbers or columns."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(F.get(x, lit(feature)) <= lit(cut), lit(below)).otherwise(lit(above))


def _score_stumps(fitted: FittedModel, df: DataFrame) -> DataFrame:
    """The stumps are one array in the plan and their votes one sum over it, so the plan does not grow with the rounds."""
    alphas = fitted.params["alphas"]
    stumps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(f).alias("f"), F.lit(float(c)).alias("c"), F.lit(p).alias("p"), F.lit(q).alias("q"))
                       for a, (f, c, p, q) in zip(alphas, map(_stump, fitted.models), strict=True)])
    total = F.aggregate(stumps, F.lit(0.0), lambda t, s: t + s["a"] * (
        _stump_side(F.col("_x"), s["f"], s["c"], s["p"], s["q"]) * F.lit(2.0) - F.lit(1.0)))
    out = df.withColumn("_x", vector_to_array("features"))
    out = out.withColumn("score", (total / F.lit(sum(alphas)) + F.lit(1.0)) / F.lit(2.0)).drop("_x")
    return out.withColumn("prediction", (F.col("score") > 0.5).cast("int"))


def _extra_trees(ctx: FitContext):
    """F14 ExtraTrees: at each node one uniform cut for each of sqrt(d) features, every row in every tree,
    balanced class weights, at least 20 rows to split. Exact algorithm."""

    def fit(train: DataFrame) -> FittedModel:
        return grown_forest(grow_forest(train, ctx.n_features, ctx.size("trees", 200), ctx.size("depth", 15), "random", min_split=20, seed=ctx.seed))

    return fit


def _balanced_rf(ctx: FitContext):
    """F22 BalancedRandomForest: 100 trees, each on its own sample with as many draws (with replacement) of either
    class. Exact algorithm but for the cuts, which are the best of 31 quantiles."""

    def fit(train: DataFrame) -> FittedModel:
        return balanced_forest(train, ctx.n_features, ctx.size("trees", 100), ctx.size("depth", 10), ctx.seed)

    return fit


def balanced_forest(train: DataFrame, n_features: int, trees: int, depth: int, seed: int, **kw) -> FittedModel:
    n = {int(r["label"]): r["count"] for r in train.groupBy("label").count().collect()}  # one row a class
    if not n.get(0) or not n.get(1):
        raise ValueError("a balanced forest needs both classes")
    samples = BalancedSamples((n[0], n[1]), seed)
    samples.level(train.select("key", F.col("label").cast("int").alias("label"), "weight", vector_to_array("features").alias("x")), trees)
    return grown_forest(grow_forest(train, n_features, trees, depth, "bins", samples, seed=seed, **kw))


def grown_forest(grown: Grown) -> FittedModel:
    return FittedModel("forest", params=grown.to_params())


def _score_forest(fitted: FittedModel, df: DataFrame) -> DataFrame:
    out = df.withColumn("score", score_udf(df.sparkSession, Grown.from_params(fitted.params))(vector_to_array("features")))
    return out.withColumn("prediction", (F.col("score") > 0.5).cast("int"))


def _pos_weighted(build_est):
    """GBT with positive rows weighted by n_neg/n_pos (scale_pos_weight)."""

    def build(ctx: FitContext):
        def fit(train: DataFrame) -> FittedModel:
            t = train.withColumn("_spw", F.when(F.col("label") == 1, F.lit(ctx.scale_pos_weight)).otherwise(F.lit(1.0)))
            est = build_est(ctx).setWeightCol("_spw")
            return fitted_ml(est.fit(t))

        return fit

    return build


def _bernoulli_nb(ctx: FitContext):
    """F11 BernoulliNB: features binarised at 0, Bernoulli NB, smoothing 1. Family."""

    def fit(train: DataFrame) -> FittedModel:
        bz = _signs()
        nb = NaiveBayes(featuresCol="_bin", labelCol="label", modelType="bernoulli", smoothing=1.0).fit(bz.transform(train))
        return FittedModel("signs", [nb])

    return fit


def _signs() -> Binarizer:
    return Binarizer(threshold=0.0, inputCol="features", outputCol="_bin")


def _score_signs(fitted: FittedModel, df: DataFrame) -> DataFrame:
    return _score_ml(fitted, _signs().transform(df))


SCORERS = {
    "ml": _score_ml, "decision": _score_decision, "margin": _score_margin, "platt": _score_platt, "discriminant": _score_discriminant,
    "knn": _score_knn, "stumps": _score_stumps, "forest": _score_forest, "signs": _score_signs,
}


def _lr(ctx, l1=False):
    return LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / max(1, ctx.n_train),
                              elasticNetParam=1.0 if l1 else 0.0, standardization=False, maxIter=ctx.size("iterations", 1000), tol=1e-10)


def _rf(ctx, trees, depth, **kw):
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=ctx.size("trees", trees),
                                  maxDepth=ctx.size("depth", depth), seed=ctx.seed, **kw)


def _gbt(ctx, depth=7, sub=1.0):
    return GBTClassifier(featuresCol="features", labelCol="label", maxIter=ctx.size("rounds", 200),
                         maxDepth=ctx.size("depth", depth), stepSize=0.1, subsamplingRate=sub, seed=ctx.seed)


_tree = _ml(lambda c: DecisionTreeClassifier(featuresCol="features", labelCol="label", maxDepth=c.size("depth", 30), seed=c.seed), weighted=True)

# Model and category names of the reference.
REGISTRY: list[ModelSpec] = [
    ModelSpec("Linear_LogisticRegression", "Linear", _ml(lambda c: _lr(c), weighted=True), "Exact"),
    ModelSpec("Linear_LogisticRegression_L1", "Linear", _ml(lambda c: _lr(c, True), weighted=True), "Exact"),
    ModelSpec("Linear_RidgeClassifier", "Linear", _ridge, "Exact"),
    ModelSpec("Linear_SGDClassifier", "Linear",
              _ml(lambda c: LinearSVC(featuresCol="features", labelCol="label", regParam=1e-4,
                                      standardization=False, maxIter=c.size("iterations", 1000)), weighted=True, has_prob=False),
              "Exact objective"),
    ModelSpec("Linear_LinearDiscriminant", "Linear", _discriminant(False), "Exact"),
    ModelSpec("Linear_QuadraticDiscriminant", "Linear", _discriminant(True), "Exact"),
    ModelSpec("SVM_LinearSVC", "SVM", _squared_hinge, "Exact"),
    ModelSpec("SVM_SVC_Linear", "SVM", _platt_svc),
    ModelSpec("NaiveBayes_GaussianNB", "NaiveBayes",
              _ml(lambda c: NaiveBayes(featuresCol="features", labelCol="label", modelType="gaussian"))),
    ModelSpec("NaiveBayes_BernoulliNB", "NaiveBayes", _bernoulli_nb),
    ModelSpec("KNN_K5", "KNN", _knn_model(5), "Exact"),
    ModelSpec("KNN_K10", "KNN", _knn_model(10), "Exact"),
    ModelSpec("Tree_DecisionTree", "Trees", _tree),
    ModelSpec("Tree_DecisionTree_Deep", "Trees", _tree, fits_as="Tree_DecisionTree"),
    ModelSpec("Ensemble_RandomForest", "Ensemble_Classic",
              _ml(lambda c: _rf(c, 200, 15, minInstancesPerNode=10, featureSubsetStrategy="sqrt"), weighted=True)),
    ModelSpec("Ensemble_ExtraTrees", "Ensemble_Classic", _extra_trees, "Exact algorithm"),
    ModelSpec("Ensemble_AdaBoost", "Ensemble_Classic", _adaboost, "Exact algorithm", long=True),
    ModelSpec("Ensemble_GradientBoosting", "Ensemble_Classic", _ml(lambda c: _gbt(c, 7, 0.8)), long=True),
    ModelSpec("Ensemble_Bagging", "Ensemble_Classic",
              _ml(lambda c: _rf(c, 200, 30, featureSubsetStrategy="all", subsamplingRate=0.7))),
    ModelSpec("GradBoost_XGBoost", "GradientBoosting", _pos_weighted(lambda c: _gbt(c, 7)), "Approx", long=True),
    ModelSpec("GradBoost_LightGBM", "GradientBoosting", _pos_weighted(lambda c: _gbt(c, 7)), "Approx", fits_as="GradBoost_XGBoost", long=True),
    ModelSpec("GradBoost_CatBoost", "GradientBoosting", _ml(lambda c: _gbt(c, 7)), "Approx", long=True),
    ModelSpec("NeuralNet_MLP_Small", "NeuralNetwork", _mlp(50)),
    ModelSpec("NeuralNet_MLP_Medium", "NeuralNetwork", _mlp(50, 25)),
    ModelSpec("Imbalance_BalancedRandomForest", "Imbalance", _balanced_rf),
]

BY_NAME = {m.name: m for m in REGISTRY}
