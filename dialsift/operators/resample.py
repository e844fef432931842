"""Over-sampling and cleaning of imbalanced data.

Input: ``(key, y, vec)`` with ``vec`` an array of doubles and binary ``y``
(1 = minority). Synthetic rows are a pure function of their id, the seed and
the neighbour lists: every choice is a key-hashed uniform draw, so reruns and
retried tasks produce the same rows, and SQL can recompute them.

SMOTE (Chawla et al. 2002): base row and one of its k minority neighbours
uniformly, point x + u·(nn - x). ADASYN (He et al. 2008): per minority row
g_i = rint(r_i / Σr · G) new points, r_i the majority share among its k
nearest rows of all classes. Tomek links (Tomek 1976): mutual 1-NN pairs of
opposite classes; SMOTETomek removes both ends after SMOTE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import uniform
from ..session import write_shared
from .knn import knn
from .ordered import running_totals


def first_free_key(df: DataFrame, key: str = "key") -> int:
    """Synthetic rows are numbered from here: one above the largest source key."""
    return (df.agg(F.max(key).alias("k")).first()["k"] or 0) + 1


def _need(n_min: int, k: int, name: str) -> None:
    if n_min <= k:
        raise ValueError(f"{name} with k={k} needs more than {k} minority rows, got {n_min}")


def _counts(df: DataFrame, y: str) -> tuple[int, int]:
    rows = {r[y]: r["count"] for r in df.groupBy(y).count().collect()}  # one row per class
    return rows.get(0, 0), rows.get(1, 0)


def _interpolate(base_vec, nb_vec, gap):
    return F.zip_with(base_vec, nb_vec, lambda a, b: a + gap * (b - a))


def neighbour_arrays(nn: DataFrame, vectors: DataFrame) -> DataFrame:
    """(key, nb_keys, nb_vecs): each row's k neighbours in rank order, with
    their vectors, as arrays (one bounded ``collect_list`` of k entries per
    row). Synthetic rows then read their neighbour with ``element_at``
    instead of joining once per generated row."""
    j = nn.join(vectors.select(F.col("key").alias("neighbour"), F.col("vec").alias("nvec")), "neighbour")
    g = j.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour", "nvec"))).alias("_nb"))
    return g.select("key", F.col("_nb.neighbour").alias("nb_keys"), F.col("_nb.nvec").alias("nb_vecs"))


def smote_samples(df: DataFrame, k: int = 5, seed: int = 42, key: str = "key", y: str = "y", vec: str = "vec",
                  n_new: int | None = None, broadcast_limit: int = 50_000) -> DataFrame:
    """Synthetic minority rows: (synth_id, base_key, neighbour_key, gap, vec).
    Draws come from ``spark.range`` (spread over tasks) and meet their base
    row, which already carries its neighbour arrays, in one equi-join."""
    n_maj, n_min = _counts(df, y)
    if n_new is None:
        n_new = n_maj - n_min
    spark = df.sparkSession
    minority = df.where(F.col(y) == 1).select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("vec"))
    if n_new <= 0:
        return spark.createDataFrame([], "synth_id long, base_key long, neighbour_key long, gap double, vec array<double>")
    _need(n_min, k, "SMOTE")
    indexed = running_totals(minority, [F.col("key").asc()], [], rank_col="_idx").withColumn("_idx", F.col("_idx") - 1)
    nn = knn(minority, minority, k, broadcast_limit=broadcast_limit)
    bases = indexed.join(neighbour_arrays(nn, minority), "key")
    j = F.col("synth_id")
    draws = spark.range(n_new).select(F.col("id").alias("synth_id")).select(
        "synth_id",
        F.floor(uniform(j, seed, "smote_base") * F.lit(n_min)).cast("long").alias("_idx"),
        (F.lit(1) + F.floor(uniform(j, seed, "smote_nn") * F.lit(k))).cast("int").alias("rank"),
        uniform(j, seed, "smote_gap").alias("gap"),
    )
    got = draws.join(bases, "_idx")
    return got.select(
        "synth_id",
        F.col("key").alias("base_key"),
        F.element_at("nb_keys", F.col("rank")).alias("neighbour_key"),
        "gap",
        _interpolate(F.col("vec"), F.element_at("nb_vecs", F.col("rank")), F.col("gap")).alias("vec"),
    )


def smote(df: DataFrame, k: int = 5, seed: int = 42, key: str = "key", y: str = "y", vec: str = "vec") -> DataFrame:
    """Original rows plus SMOTE rows until both classes have n_maj rows (E5);
    columns (key, y, vec, is_synthetic)."""
    orig = df.select(F.col(key).alias("key"), F.col(y).cast("int").alias("y"), F.col(vec).cast("array<double>").alias("vec"),
                     F.lit(False).alias("is_synthetic"))
    syn = smote_samples(df, k, seed, key, y, vec).select(
        (F.col("synth_id") + F.lit(first_free_key(df, key))).alias("key"), F.lit(1).alias("y"), "vec",
        F.lit(True).alias("is_synthetic"),
    )
    return orig.unionByName(syn)


def tomek_links(df: DataFrame, key: str = "key", y: str = "y", vec: str = "vec",
                broadcast_limit: int = 50_000) -> DataFrame:
    """Mutual nearest neighbours of opposite classes: (key_a, key_b), a < b."""
    base = df.select(F.col(key).alias("key"), F.col(y).cast("int").alias("y"), F.col(vec).alias("vec"))
    nn = knn(base, base, 1, broadcast_limit=broadcast_limit).select("key", "neighbour")
    lab = base.select("key", "y")
    a = nn.alias("a")
    b = nn.alias("b")
    mutual = a.join(b, (F.col("a.key") == F.col("b.neighbour")) & (F.col("a.neighbour") == F.col("b.key"))).select(
        F.col("a.key").alias("k1"), F.col("a.neighbour").alias("k2")
    ).where(F.col("k1") < F.col("k2"))
    out = mutual.join(lab.select(F.col("key").alias("k1"), F.col("y").alias("y1")), "k1").join(
        lab.select(F.col("key").alias("k2"), F.col("y").alias("y2")), "k2"
    )
    return out.where(F.col("y1") != F.col("y2")).select(F.col("k1").alias("key_a"), F.col("k2").alias("key_b"))


def remove_tomek(df: DataFrame, key: str = "key", y: str = "y", vec: str = "vec") -> DataFrame:
    """Drop both ends of every Tomek link."""
    links = tomek_links(df, key, y, vec)
    ends = links.select(F.col("key_a").alias(key)).unionByName(links.select(F.col("key_b").alias(key))).distinct()
    return df.join(ends, key, "left_anti")


def smote_tomek(df: DataFrame, k: int = 5, seed: int = 42, key: str = "key", y: str = "y", vec: str = "vec") -> DataFrame:
    """SMOTE, then Tomek-link cleaning of the augmented set (SMOTETomek)."""
    aug = write_shared(smote(df, k, seed, key, y, vec), "smote")
    return remove_tomek(aug, "key", "y", "vec")


ADASYN_CHUNK = 10_000  # synthetic rows generated per task slot for one base row


def adasyn_samples(df: DataFrame, k: int = 5, seed: int = 42, key: str = "key", y: str = "y", vec: str = "vec",
                   broadcast_limit: int = 50_000, chunk: int = ADASYN_CHUNK) -> DataFrame:
    """Synthetic ADASYN rows: (synth_id, base_key, s, neighbour_key, gap, vec) (E7);
    ``synth_id`` numbers them from 0 in the order of (base_key, s), by running totals
    over the base rows.

    One hard row may own most of the G new points. Its g points are cut into
    chunks of ``chunk`` ids that are spread over tasks by a repartition on
    (key, chunk) before being generated, and each generated row reads its
    neighbour from the base row's arrays: no join follows the explosion."""
    n_maj, n_min = _counts(df, y)
    G = n_maj - n_min
    _need(n_min, k, "ADASYN")
    base = df.select(F.col(key).alias("key"), F.col(y).cast("int").alias("y"), F.col(vec).cast("array<double>").alias("vec"))
    minority = base.where(F.col("y") == 1)
    # hardness: majority share among the k nearest rows of any class
    nn_all = knn(minority, base, k, broadcast_limit=broadcast_limit)
    lab = base.select(F.col("key").alias("neighbour"), F.col("y").alias("ny"))
    hard = nn_all.join(lab, "neighbour").groupBy("key").agg(
        (F.sum((F.lit(1) - F.col("ny")).cast("double")) / F.lit(float(k))).alias("r")
    )
    total_r = hard.agg(F.sum("r").alias("s")).first()["s"] or 0.0
    if total_r == 0.0:
        raise ValueError("ADASYN: no minority row has majority neighbours (sum of ratios is 0)")
    g = hard.withColumn("g", F.rint(F.col("r") / F.lit(total_r) * F.lit(float(G))).cast("int")).where(F.col("g") > 0)
    g = running_totals(g.select("key", "g"), [F.col("key").asc()], [], {"upto": F.col("g")}, rank_col="_r").drop("_r")
    nn_min = knn(minority, minority, k, broadcast_limit=broadcast_limit)
    rows = g.join(minority, "key").join(neighbour_arrays(nn_min, minority), "key")
    chunks = rows.withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("g") - F.lit(1)) / F.lit(chunk)).cast("int")))
    ).repartition("key", "chunk")
    gen = chunks.withColumn(
        "s",
        F.explode(F.sequence(F.col("chunk") * F.lit(chunk) + F.lit(1),
                             F.least((F.col("chunk") + F.lit(1)) * F.lit(chunk), F.col("g")))),
    )
    sid = F.concat_ws("-", F.col("key").cast("string"), F.col("s").cast("string"))
    gen = gen.withColumn("rank", (F.lit(1) + F.floor(uniform(sid, seed, "adasyn_nn") * F.lit(k))).cast("int"))
    gen = gen.withColumn("gap", uniform(sid, seed, "adasyn_gap"))
    return gen.select(
        (F.col("upto") - F.col("g") + F.col("s") - F.lit(1)).cast("long").alias("synth_id"),
        F.col("key").alias("base_key"),
        "s",
        F.element_at("nb_keys", F.col("rank")).alias("neighbour_key"),
        "gap",
        _interpolate(F.col("vec"), F.element_at("nb_vecs", F.col("rank")), F.col("gap")).alias("vec"),
    )


def adasyn(df: DataFrame, k: int = 5, seed: int = 42, key: str = "key", y: str = "y", vec: str = "vec") -> DataFrame:
    orig = df.select(F.col(key).alias("key"), F.col(y).cast("int").alias("y"), F.col(vec).cast("array<double>").alias("vec"),
                     F.lit(False).alias("is_synthetic"))
    syn = adasyn_samples(df, k, seed, key, y, vec)
    syn = syn.select(
        (F.lit(first_free_key(df, key)) + F.col("synth_id")).alias("key"),
        F.lit(1).alias("y"), "vec", F.lit(True).alias("is_synthetic"),
    )
    return orig.unionByName(syn)


def balanced_datasets(df: DataFrame, k: int = 5, seed: int = 42, ratio: float = 0.5, key: str = "key",
                      y: str = "y", vec: str = "vec", errors: dict | None = None,
                      names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The five named training sets of the reference (E8), or those in ``names``. A technique that
    cannot apply (e.g. undersampling a set already above the ratio, ADASYN
    without hard rows) is left out and its message stored in ``errors``
    (S19: guarded, not fatal)."""
    from .sampling import random_undersample

    orig = df.select(F.col(key).alias("key"), F.col(y).cast("int").alias("y"), F.col(vec).cast("array<double>").alias("vec"),
                     F.lit(False).alias("is_synthetic"))
    builders = {
        "Original": lambda: orig,
        "SMOTE": lambda: smote(df, k, seed, key, y, vec),
        "Undersampling": lambda: random_undersample(orig, "key", "y", ratio, seed),
        "SMOTETomek": lambda: smote_tomek(df, k, seed, key, y, vec),
        "ADASYN": lambda: adasyn(df, k, seed, key, y, vec),
    }
    out: dict[str, DataFrame] = {}
    for name, build in builders.items():
        if names is not None and name not in names:
            continue
        try:
            out[name] = build()
        except ValueError as e:
            if errors is not None:
                errors[name] = str(e)
    return out
