"""Linear SVM with the squared hinge loss (F7) by Newton's method.

Objective: |w|²/2 + C·Σ s·max(0, 1 - t·(w·x + b))², labels t = ±1, weights s; the intercept is the
weight of a constant feature and is penalised like the others. The loss is quadratic on the rows inside the
margin, so a Newton step solves a weighted least-squares problem over them. Each step is one
aggregate: tasks reduce their Arrow batches to the gradient, the Hessian and the losses along the last direction,
a groupBy sums these on the executors, and (d+1)² numbers reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = tuple(0.5**k for k in range(12))  # lengths tried along a direction, in one pass


def squared_hinge_terms(X: np.ndarray, t: np.ndarray, s: np.ndarray, w: np.ndarray, direction: np.ndarray, c: float) -> np.ndarray:
    """Loss at w + step·direction for each step, then gradient and Hessian (by rows) at w + direction, of the data term."""
    X = np.column_stack([X, np.ones(len(X))])
    at, along = X @ w, X @ direction
    gap = 1 - t[:, None] * (at[:, None] + along[:, None] * np.array(STEPS))
    losses = c * (s[:, None] * np.maximum(gap, 0) ** 2).sum(axis=0)
    inside = gap[:, 0] > 0
    A, sa = X[inside], s[inside]
    residual = at[inside] + along[inside] - t[inside]
    return np.concatenate([losses, 2 * c * A.T @ (sa * residual), (2 * c * (A * sa[:, None]).T @ A).ravel()])


def _sums(rows: DataFrame, w: np.ndarray, direction: np.ndarray, c: float) -> np.ndarray:
    size = len(STEPS) + len(w) + len(w) ** 2

    def part(batches):
        total = np.zeros(size)
        for b in batches:
            if len(b):
                X = np.stack(b["x"].to_numpy()).astype(np.float64)
                total += squared_hinge_terms(X, 2.0 * b["label"].to_numpy() - 1, b["weight"].to_numpy(), w, direction, c)
        yield pd.DataFrame({"slot": np.arange(size, dtype=np.int32), "v": total})

    out = np.zeros(size)
    for r in rows.mapInPandas(part, "slot int, v double").groupBy("slot").agg(F.sum("v").alias("v")).collect():  # (d+1)² numbers
        out[r["slot"]] = r["v"]
    return out


def fit_squared_hinge(train: DataFrame, n_features: int, c: float = 1.0, max_steps: int = 1000, tolerance: float = 1e-10) -> np.ndarray:
    """Weights and, last, the intercept, for ``train`` (label, weight, features)."""
    rows = train.select("label", "weight", vector_to_array("features").alias("x"))
    d = n_features + 1
    w, direction, before, expected = np.zeros(d), np.zeros(d), np.inf, 0.0
    for _ in range(max_steps):
        sums = _sums(rows, w, direction, c)
        loss = [x + 0.5 * ((w + step * direction) ** 2).sum() for x, step in zip(sums, STEPS, strict=False)]
        if loss[0] > before + 1e-4 * expected:  # the whole step goes too far: take the best shorter one
            shorter = STEPS[int(np.argmin(loss))] * direction
            if min(loss) >= before:
                break
            w, direction = w + shorter, np.zeros(d)
            before, expected = min(loss), 0.0
            continue
        w = w + direction
        gradient = sums[len(STEPS):len(STEPS) + d] + w
        hessian = sums[len(STEPS) + d:].reshape(d, d) + np.eye(d)
        if np.abs(gradient).max() <= tolerance * max(1.0, loss[0]):
            break
        before, direction = loss[0], -np.linalg.solve(hessian, gradient)
        expected = float(gradient @ direction)
    return w
