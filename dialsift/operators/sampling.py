"""Splits, undersampling and folds.

Randomness is key-hashed (:func:`uniform`): a row's draw depends only on its
key, the seed and a tag, so results are reproducible, retried tasks agree,
and the same draws are computable in SQL. "The q rows with the smallest draws"
is a threshold: :func:`draw_thresholds` finds the q-th (draw, key) of each class
by distributed selection, and the sample is then a filter or a column. No row
is shuffled or ranked for it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import uniform
from .ordered import running_totals

STEPS = 4096  # buckets of a selection pass


def _class_counts(df: DataFrame, label: str) -> dict[int, int]:
    rows = df.groupBy(label).count().collect()  # one row per class
    return {r[label]: r["count"] for r in rows}


def _largest_remainder(counts: dict[int, int], draws: int) -> dict[int, int]:
    """sklearn's allocation of ``draws`` over classes: floor of the
    proportional share, leftovers to the largest remainders (ties: smaller
    class value first)."""
    total = sum(counts.values())
    cont = {c: n * draws / total for c, n in counts.items()}
    out = {c: math.floor(v) for c, v in cont.items()}
    left = draws - sum(out.values())
    for c in sorted(counts, key=lambda c: (-(cont[c] - out[c]), c)):
        if left <= 0:
            break
        out[c] += 1
        left -= 1
    return out


def draw_thresholds(draws: DataFrame, quota: dict[int, int]) -> dict[int, tuple[float, object]]:
    """The quota-th smallest (u, key) of each class of ``draws`` (c, u, key), 0 < quota <= class size.

    Two passes count draws by bucket (at most STEPS rows per class come back); the third
    fetches the rows of the one fine bucket that holds the threshold: 1/STEPS^2 of the class."""
    inside: dict[int, Column] = {c: F.col("c") == F.lit(c) for c in quota}
    left = dict(quota)
    for scale in (STEPS, STEPS * STEPS):
        bucket = F.floor(F.col("u") * F.lit(scale))
        counts = draws.filter(reduce(lambda a, b: a | b, inside.values())).groupBy("c", bucket.alias("b")).count().collect()
        by_class: dict[int, list[tuple[int, int]]] = {}
        for r in counts:
            by_class.setdefault(r["c"], []).append((r["b"], r["count"]))
        for c, found in by_class.items():
            for b, n in sorted(found):
                if left[c] <= n:
                    inside[c] = (F.col("c") == F.lit(c)) & (bucket == F.lit(b))
                    break
                left[c] -= n
    rows = draws.filter(reduce(lambda a, b: a | b, inside.values())).collect()
    out = {}
    for c in quota:
        own = sorted((r["u"], r["key"]) for r in rows if r["c"] == c)
        out[c] = own[left[c] - 1]
    return out


def smallest_draws(df: DataFrame, key: str, label: str | None, quota: dict[int, int], counts: dict[int, int], u: Column) -> Column:
    """Whether a row is among the quota of its class (one class, 0, without a label)."""
    c = F.col(label) if label else F.lit(0)
    asked = {k: q for k, q in quota.items() if 0 < q < counts[k]}
    found = draw_thresholds(df.select(c.alias("c"), u.alias("u"), F.col(key).alias("key")), asked) if asked else {}
    out = F.lit(False)
    for k, q in quota.items():
        if q >= counts[k]:
            own = F.lit(True)
        elif q <= 0:
            own = F.lit(False)
        else:
            t, last = found[k]
            own = (u < F.lit(t)) | ((u == F.lit(t)) & (F.col(key) <= F.lit(last)))
        out = F.when(c == F.lit(k), own).otherwise(out)
    return out


def stratified_split(df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = 42,
                     stratify: bool = True) -> DataFrame:
    """Adds ``split`` in {'train','test'} (E1/E2). Test size is
    ceil(n·test_size); with ``stratify`` the train share of each class is the
    largest-remainder allocation and the test share the rest, as sklearn.
    Within a class the rows with the smallest draws go to test."""
    counts = _class_counts(df, label)
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    u = uniform(key, seed, "split")
    if stratify:
        train_q = _largest_remainder(counts, n - n_test)
        is_test = smallest_draws(df, key, label, {c: counts[c] - train_q[c] for c in counts}, counts, u)
    else:
        is_test = smallest_draws(df, key, None, {0: n_test}, {0: n}, u)
    return df.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train")))


def random_undersample(df: DataFrame, key: str, label: str, ratio: float = 0.5, seed: int = 42,
                       tag: str = "undersample") -> DataFrame:
    """Keep every minority row and floor(n_min / ratio) majority rows drawn
    without replacement (E3, binary labels). Raises when the majority class
    is already smaller than that."""
    counts = _class_counts(df, label)
    minority = min(counts, key=lambda c: (counts[c], c))
    majority = max(counts, key=lambda c: (counts[c], -c))
    keep = int(counts[minority] / ratio)
    if keep > counts[majority]:
        raise ValueError(f"ratio {ratio} needs {keep} majority rows, only {counts[majority]} exist")
    quota = {c: keep if c == majority else n for c, n in counts.items()}
    return df.where(smallest_draws(df, key, label, quota, counts, uniform(key, seed, tag)))


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 2, seed: int = 42, fold_col: str = "fold") -> DataFrame:
    """Class-balanced fold id in [0, k): rank inside the class by the draw,
    modulo k (E9). Fold sizes differ by at most one per class. Only (key, label)
    is ranked; other columns meet their fold in a join on the key."""
    narrow = df.select(key, label)
    ranked = running_totals(narrow.withColumn("_u", uniform(key, seed, "fold")), [F.col("_u"), F.col(key)], [label], rank_col="_r")
    folds = ranked.withColumn(fold_col, ((F.col("_r") - F.lit(1)) % F.lit(k)).cast("int")).drop("_u", "_r")
    return folds if set(df.columns) == {key, label} else df.join(folds.drop(label), key)
