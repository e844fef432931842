"""Exact k nearest neighbours (E4): Euclidean, self excluded, ties by key.

Two physical forms, chosen by a size check of the reference side:

* reference rows and bytes below a limit: the reference matrix is shipped once
  to every executor (broadcast variable of a checked size) and each query
  partition is scored with NumPy in ``mapInPandas``;
* larger: a pivot tree searched in rounds (``knn_tree``). No distance row is ever
  materialised, only top-k lists.

Candidates are pre-selected with the BLAS form |q|²+|r|²-2q·r and re-scored
with the direct difference form, keeping every candidate within a small
tolerance of the k-th distance, so ties and rounding cannot drop a true
neighbour.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn_tree import knn_by_tree

KNN_SCHEMA = "key long, neighbour long, rank int, distance double"


SPARE = 8  # candidates kept beyond k before exact distances decide


def _topk(qk: np.ndarray, Q: np.ndarray, rk: np.ndarray, R: np.ndarray, k: int, exclude_self: bool) -> pd.DataFrame:
    """The k nearest rows of R for each row of Q."""
    row, at, distance = topk_rows(Q, rk, R, k, qk if exclude_self else None)
    return pd.DataFrame({"key": qk[row].astype(np.int64), "neighbour": rk[at].astype(np.int64),
                         "rank": (np.arange(len(row)) - np.searchsorted(row, row) + 1).astype(np.int32), "distance": distance})


def topk_rows(Q: np.ndarray, rk: np.ndarray, R: np.ndarray, k: int, qk: np.ndarray | None = None):
    """(row of Q, row of R, distance) of the k nearest rows of R, nearest first, ties by their keys ``rk``;
    rows of equal key are left out where ``qk`` is given. In strips of bounded size."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(Q) and len(rk):
        rn = (R * R).sum(1)
        step = max(1, int(2_000_000 // len(rk)))
        for s in range(0, len(Q), step):
            row, at, distance = _strip(None if qk is None else qk[s:s + step], Q[s:s + step], rk, R, rn, k)
            parts.append((row + s, at, distance))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _strip(keys, q, rk, R, rn, k):
    d2 = (q * q).sum(1)[:, None] + rn[None, :] - 2.0 * (q @ R.T)
    if keys is not None:
        d2[keys[:, None] == rk[None, :]] = np.inf
    n, m = d2.shape
    take = min(k + SPARE, m)
    cand = np.argpartition(d2, take - 1, axis=1)[:, :take] if take < m else np.tile(np.arange(m), (n, 1))
    near = np.take_along_axis(d2, cand, axis=1)
    # the k-th distance and its rounding tolerance; a row with more ties than spare candidates takes all of them
    cut = np.partition(near, min(k, take) - 1, axis=1)[:, min(k, take) - 1]
    edge = near.max(axis=1)
    tied = (take < m) & np.isfinite(edge) & (edge <= cut + 1e-9 * np.maximum(1.0, np.abs(cut)))
    row = np.repeat(np.arange(n), take)
    flat = cand.ravel()
    keep = np.isfinite(near).ravel() & ~tied[row]
    row, flat = row[keep], flat[keep]
    for i in np.flatnonzero(tied):
        own = np.flatnonzero(d2[i] <= cut[i] + 1e-9 * max(1.0, abs(cut[i])))
        row, flat = np.concatenate([row, np.full(len(own), i)]), np.concatenate([flat, own])
    exact = np.empty(len(row))
    for a in range(0, len(row), 1 << 16):
        b = a + (1 << 16)
        exact[a:b] = np.sqrt(((R[flat[a:b]] - q[row[a:b]]) ** 2).sum(1))
    order = np.lexsort((rk[flat], exact, row))
    row, flat, exact = row[order], flat[order], exact[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row, side="left") + 1
    best = rank <= k
    return row[best], flat[best], exact[best]


def _matrix(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in series.to_numpy()])


def knn(query: DataFrame, ref: DataFrame, k: int = 5, key: str = "key", vec: str = "vec", exclude_self: bool = True,
        broadcast_limit: int = 50_000, block_rows: int = 4096, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(key, neighbour, rank, distance): the k nearest ``ref`` rows of every
    ``query`` row. The reference side is broadcast if it has at most ``broadcast_limit`` rows and
    ``broadcast_bytes`` of numbers; otherwise a pivot tree with leaves of about ``block_rows`` rows is searched."""
    q = query.select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("vec"))
    r = ref.select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("vec"))
    size = r.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("vec") + 1), F.lit(0)).alias("numbers")).first()
    n_ref = size["n"]
    if n_ref <= broadcast_limit and 8 * size["numbers"] <= broadcast_bytes:
        pdf = r.toPandas()  # bounded by both checks
        bc = query.sparkSession.sparkContext.broadcast((pdf["key"].to_numpy(np.int64), _matrix(pdf["vec"])))

        def score(batches):
            rk, R = bc.value
            for b in batches:
                yield _topk(b["key"].to_numpy(np.int64), _matrix(b["vec"]), rk, R, k, exclude_self)

        return q.mapInPandas(score, KNN_SCHEMA)

    return knn_by_tree(q, r, k, exclude_self, block_rows)
