"""Forests grown level by level, all trees at once.

Spark's forests have one kind of cut (the best of global bins) and one kind of sample. Here a tree may cut
at random (extra trees) and has its own weight for every row (balanced samples):

* ``cuts="random"``: for each node and candidate feature one cut, uniform between the least and the greatest value
  in the node, as extra trees draw it; two aggregates a level (ranges, then class weights below the cuts);
* ``cuts="bins"``: the best of at most ``BINS`` - 1 global quantile cuts; one aggregate a level.

An aggregate is one scan of the training rows for a group of nodes of *all* trees: a task finds the node of each row in
each tree, reduces its Arrow batches to one array of sums for each block of nodes, a groupBy adds (or
takes the least and greatest of) these on the executors, and sums of a bounded number of nodes reach the driver
(``CELLS`` numbers), which chooses the cuts. A tree's row weights are a function of the row's key, the seed and the tree, so no
sample is written and a retried task draws the same one.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = 2_000_000  # numbers of one aggregate
BLOCK = 256  # nodes of one partial result
ROWS_AT_ONCE = 2048
BINS = 32


@dataclass
class Grown:
    """Trees as padded arrays (tree, node): cut feature (-1 in a leaf), cut, left child (right is the next), share of class 1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def nodes_of(self, X: np.ndarray, steps: int) -> np.ndarray:
        """The node that each row reaches in each tree."""
        trees = np.arange(len(self.feature))
        at = np.zeros((len(X), len(trees)), np.int32)
        rows = np.arange(len(X))[:, None]
        for _ in range(steps):
            f = self.feature[trees, at]
            moves = f >= 0
            if not moves.any():
                break
            below = X[rows, np.maximum(f, 0)] <= self.cut[trees, at]
            at = np.where(moves, self.left[trees, at] + ~below, at)
        return at

    def scores(self, X: np.ndarray) -> np.ndarray:
        """Mean over the trees of the class 1 share in the row's leaf."""
        trees = np.arange(len(self.feature))
        out = [self.value[trees, self.nodes_of(X[s:s + ROWS_AT_ONCE], self.feature.shape[1])].mean(axis=1) for s in range(0, len(X), ROWS_AT_ONCE)]
        return np.concatenate(out) if out else np.zeros(0)

    def to_params(self) -> dict:
        return {k: getattr(self, k).tolist() for k in ("feature", "cut", "left", "value")}

    @classmethod
    def from_params(cls, params: dict) -> Grown:
        return cls(*(np.array(params[k], t) for k, t in (("feature", np.int32), ("cut", float), ("left", np.int32), ("value", float))))


# ---------------------------------------------------------------- row weights


def uniform_of(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number in [0, 1) from (key, seed, tree)."""
    x = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + tree * 7919 + 1) & 0xFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def poisson_draws(keys: np.ndarray, rate: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is drawn into a tree's sample: Poisson with its class's rate (draws with replacement)."""
    u, out = uniform_of(keys, seed, tree), np.zeros(len(keys))
    term = np.exp(-rate)
    total = term.copy()
    for k in range(1, 20):
        out += u >= total
        term = term * rate / k
        total += term
    return out


class ClassWeights:
    """Every row in every tree, with its weight column (class_weight='balanced')."""

    def __call__(self, keys, labels, weights, trees: int) -> np.ndarray:
        return np.repeat(weights[:, None], trees, axis=1)


class BalancedSamples:
    """In every tree as many draws of either class, with replacement; the drawn totals are levelled by ``scale``."""

    def __init__(self, n: tuple[int, int], seed: int) -> None:
        least = min(n)
        self.rate = np.array([least / max(1, n[0]), least / max(1, n[1])])
        self.seed, self.scale = seed, None

    def draws(self, keys, labels, trees: int) -> np.ndarray:
        rate = self.rate[labels]
        return np.stack([poisson_draws(keys, rate, self.seed, t) for t in range(trees)], axis=1)

    def __call__(self, keys, labels, weights, trees: int) -> np.ndarray:
        drawn = self.draws(keys, labels, trees)
        return drawn if self.scale is None else drawn * self.scale[labels]

    def level(self, rows: DataFrame, trees: int) -> np.ndarray:
        """One scan: draws of each class in each tree; from then on both classes weigh the same in a tree."""

        def part(batches):
            total = np.zeros((2, trees))
            for _, y, _, keys in _chunks(batches):
                drawn = self.draws(keys, y, trees)
                for c in (0, 1):
                    total[c] += drawn[y == c].sum(axis=0)
            yield pd.DataFrame({"slot": np.arange(2 * trees), "v": total.ravel()})

        totals = np.zeros(2 * trees)
        for r in rows.mapInPandas(part, "slot int, v double").groupBy("slot").agg(F.sum("v").alias("v")).collect():
            totals[r["slot"]] = r["v"]
        totals = totals.reshape(2, trees)
        self.scale = np.where(totals > 0, totals.min(axis=0) / np.maximum(totals, 1), 0.0)
        return totals


# ---------------------------------------------------------------- aggregates


def _chunks(batches):
    for b in batches:
        for s in range(0, len(b), ROWS_AT_ONCE):
            part = b.iloc[s:s + ROWS_AT_ONCE]
            yield (np.stack(part["x"].to_numpy()).astype(np.float64), part["label"].to_numpy().astype(np.int64),
                   part["weight"].to_numpy(), part["key"].to_numpy())


@dataclass
class Request:
    """What a scan has to count: node slots by (tree, node), candidate features by slot, and cuts where they are drawn."""

    trees: Grown
    depth: int
    slot_of: np.ndarray
    candidates: np.ndarray
    cuts: np.ndarray | None = None
    bounds: np.ndarray | None = None  # global bin bounds by feature


def _ranges(req: Request, X, y, w, slot, row, out: np.ndarray) -> None:
    """Least and greatest value (negated: all is a minimum) of each candidate in each node."""
    for j in range(req.candidates.shape[1]):
        v = X[row, req.candidates[slot, j]]
        np.minimum.at(out[:, 0, j], slot, v)
        np.minimum.at(out[:, 1, j], slot, -v)


def _below(req: Request, X, y, w, slot, row, out: np.ndarray) -> None:
    """Class weights at or below the cut of each candidate, for the nodes of a scan."""
    n = len(out)
    for j in range(req.candidates.shape[1]):
        hit = X[row, req.candidates[slot, j]] <= req.cuts[slot, j]
        for c in (0, 1):
            own = hit & (y == c)
            out[:, c, j] += np.bincount(slot[own], w[own], n)


def _histograms(req: Request, X, y, w, slot, row, out: np.ndarray) -> None:
    """Class weights of each candidate's bins."""
    n, width = len(out), req.bounds.shape[1] + 1
    binned = np.stack([np.searchsorted(req.bounds[f], X[:, f]) for f in range(X.shape[1])], axis=1)  # values up to bound k are in bins up to k
    for j in range(req.candidates.shape[1]):
        at = slot * width + binned[row, req.candidates[slot, j]]
        for c in (0, 1):
            own = y == c
            out[:, c, j] += np.bincount(at[own], w[own], n * width).reshape(n, width)


def _scan(rows: DataFrame, req: Request, weigh: Callable, count: Callable, shape: tuple, least: bool = False) -> np.ndarray:
    """One aggregate over all rows: an array (slot, *shape) of sums, or of minima where ``least``."""
    slots = len(req.candidates)
    start = np.inf if least else 0.0
    ref = rows.sparkSession.sparkContext.broadcast(req)  # of at most CELLS numbers and the trees so far

    def part(batches):
        r, out = ref.value, np.full((slots, *shape), start)
        n_trees = len(r.trees.feature)
        for X, y, weights, keys in _chunks(batches):
            slot = r.slot_of[np.arange(n_trees), r.trees.nodes_of(X, r.depth)]
            w = weigh(keys, y, weights, n_trees)
            row, tree = np.nonzero((slot >= 0) & (w > 0))
            count(r, X, y[row], w[row, tree], slot[row, tree], row, out)
        for s in range(0, slots, BLOCK):
            block = out[s:s + BLOCK]
            if (block != start).any():
                yield pd.DataFrame({"block": [s // BLOCK], "sums": [block.tobytes()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        arrays = (np.frombuffer(x) for x in pdf["sums"])
        total = next(arrays).copy()
        for a in arrays:
            total = np.minimum(total, a) if least else total + a
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "sums": [total.tobytes()]})

    kind = "block int, sums binary"
    out = np.full((slots, *shape), start)
    for r in rows.mapInPandas(part, kind).groupBy("block").applyInPandas(merge, kind).collect():  # CELLS numbers at most
        own = out[r["block"] * BLOCK:(r["block"] + 1) * BLOCK]
        own[:] = np.frombuffer(r["sums"]).reshape(own.shape)
    ref.destroy()
    return out


# ---------------------------------------------------------------- growth


def subset_size(strategy: str, n_features: int) -> int:
    size = {"sqrt": math.isqrt(n_features), "log2": int(math.log2(max(2, n_features))), "all": n_features}.get(strategy)
    return max(1, size if size is not None else math.ceil(float(strategy) * n_features))


def _gini(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Weight times Gini impurity."""
    total = zero + one
    return np.where(total > 0, 2 * zero * one / np.maximum(total, 1e-300), 0.0)


def _bounds(rows: DataFrame, n_features: int) -> np.ndarray:
    """Quantiles of each feature: BINS - 1 global cuts."""
    columns = [f"x{k}" for k in range(n_features)]
    wide = rows.select(*[F.col("x")[k].alias(c) for k, c in enumerate(columns)])
    return np.array(wide.approxQuantile(columns, [k / BINS for k in range(1, BINS)], 0.001))


def grow_forest(train: DataFrame, n_features: int, trees: int, depth: int, cuts: str, weigh: Callable | None = None, subset: str = "sqrt",
                min_leaf: int = 1, min_split: int = 2, seed: int = 73) -> Grown:
    """A forest over ``train`` (key, label, weight, features). ``min_leaf`` and ``min_split`` are numbers of rows: row
    weights are constant in a class, so rows follow from class weights. Trees end at Spark's limit of ``depth`` 30."""
    rows = train.select("key", F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight"), vector_to_array("features").alias("x"))
    unit = np.ones(2)  # weight of one row of each class
    if weigh is None:
        weigh = ClassWeights()
        for r in rows.groupBy("label").agg(F.max("weight").alias("w")).collect():  # one row a class
            unit[r["label"]] = r["w"]
    draw = np.random.default_rng(seed)
    k = subset_size(subset, n_features)
    bounds = _bounds(rows, n_features) if cuts == "bins" else None
    width = BINS if cuts == "bins" else 1
    grown = Grown(np.full((trees, 1), -1, np.int32), np.zeros((trees, 1)), np.zeros((trees, 1), np.int32), np.zeros((trees, 1)))
    used = np.ones(trees, np.int64)
    level = [(t, 0) for t in range(trees)]
    group = max(1, CELLS // (2 * k * width))
    for step in range(depth):
        following: list[tuple[int, int]] = []
        for s in range(0, len(level), group):
            nodes = level[s:s + group]
            slot_of = np.full(grown.feature.shape, -1, np.int32)
            slot_of[tuple(np.array(nodes).T)] = np.arange(len(nodes))
            candidates = draw.random((len(nodes), n_features)).argsort(axis=1)[:, :k].astype(np.int32)
            req = Request(grown, step, slot_of, candidates, bounds=bounds)
            if cuts == "random":
                span = _scan(rows, req, weigh, _ranges, (2, k), least=True)
                low, high = span[:, 0], -span[:, 1]
                finite = np.isfinite(low)
                low, high = np.where(finite, low, 0.0), np.where(finite, high, 0.0)
                req.cuts = low + (high - low) * draw.random(low.shape)
                req.cuts = np.where(high > low, np.minimum(req.cuts, np.nextafter(high, low)), np.inf)  # a constant feature cuts nothing
                # a further candidate without a cut holds the node's totals
                req.candidates = np.column_stack([candidates, np.zeros(len(nodes), np.int32)])
                req.cuts = np.column_stack([req.cuts, np.full(len(nodes), np.inf)])
                sums = _scan(rows, req, weigh, _below, (2, k + 1))
                total, left, at = sums[:, :, -1], sums[:, :, :-1], req.cuts[:, :-1]
            else:
                hist = _scan(rows, req, weigh, _histograms, (2, k, BINS))
                total = hist[:, :, 0].sum(axis=2)
                left = hist.cumsum(axis=3)[:, :, :, :-1].reshape(len(nodes), 2, -1)
                at = bounds[candidates].reshape(len(nodes), -1)
            following += _split(grown, used, nodes, candidates, total, left, at, unit, min_leaf, min_split)
            grown = _padded(grown, used)
        level = following
        if not level:
            break
    return grown


def _split(grown: Grown, used: np.ndarray, nodes: list, candidates: np.ndarray, total: np.ndarray, left: np.ndarray, at: np.ndarray,
           unit: np.ndarray, min_leaf: int, min_split: int) -> list[tuple[int, int]]:
    """Write the best cut of each node and the shares of its children; the children that may be split further."""
    count = (total / unit).sum(axis=1)
    right = total[:, :, None] - left
    gain = _gini(total[:, 0], total[:, 1])[:, None] - _gini(left[:, 0], left[:, 1]) - _gini(right[:, 0], right[:, 1])
    sides = np.minimum((left / unit[:, None]).sum(axis=1), (right / unit[:, None]).sum(axis=1))
    gain = np.where((sides >= min_leaf - 1e-9) & (sides > 1e-9) & np.isfinite(at), gain, -np.inf)
    best = gain.argmax(axis=1)
    share = lambda c: np.where(c.sum(axis=1) > 0, c[:, 1] / np.maximum(c.sum(axis=1), 1e-300), 0.0)
    picked = np.arange(len(nodes))
    low, high = left[picked, :, best], right[picked, :, best]
    children = []
    per_feature = at.shape[1] // candidates.shape[1]
    values, lows, highs = share(total), share(low), share(high)
    for n, (tree, node) in enumerate(nodes):
        if node == 0:
            grown.value[tree, 0] = values[n]
        if count[n] < min_split - 1e-9 or not np.isfinite(gain[n, best[n]]) or (total[n] <= 1e-9).any():
            continue
        child = int(used[tree])
        used[tree] += 2
        grown.feature[tree, node], grown.cut[tree, node], grown.left[tree, node] = candidates[n, best[n] // per_feature], at[n, best[n]], child
        for k, own in enumerate((low[n], high[n])):
            children.append((tree, child + k, own))
        if child + 2 > grown.feature.shape[1]:
            _widen(grown, 2 * grown.feature.shape[1] + 2)
        grown.value[tree, child], grown.value[tree, child + 1] = lows[n], highs[n]
    return [(t, c) for t, c, own in children if (own / unit).sum() >= min_split - 1e-9 and (own > 1e-9).all()]


def _widen(grown: Grown, width: int) -> None:
    for name, empty in (("feature", -1), ("cut", 0), ("left", 0), ("value", 0)):
        old = getattr(grown, name)
        new = np.full((len(old), width), empty, old.dtype)
        new[:, :old.shape[1]] = old
        setattr(grown, name, new)


def _padded(grown: Grown, used: np.ndarray) -> Grown:
    width = int(used.max())
    return Grown(*(getattr(grown, n)[:, :width].copy() if grown.feature.shape[1] > width else getattr(grown, n) for n in ("feature", "cut", "left", "value")))


def score_udf(spark, grown: Grown):
    ref = spark.sparkContext.broadcast(grown)

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(ref.value.scores(np.stack(x.to_numpy()).astype(np.float64)) if len(x) else np.zeros(0))

    return score
