"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector for all
thresholds and thresholds kept in order by positive gaps. x holds hashed
features of the text: its lower-cased words, its word shapes (runs of letters,
capitals, digits and marks) and four coarse proportions. The fit is penalised
maximum likelihood by L-BFGS: every gradient is one Spark job over the
hashed sample, whose tasks return one vector each.

Scores: the expected grade, and the probability that the grade is at least
``select_grade``; documents below ``min_probability`` are rejected.

The fit takes at most ``max_fit_rows`` rated documents, chosen by a hash of the id.

Defined cases: null and empty texts have no words and are scored from the
proportions alone; several ratings of a document count as their rounded mean; null
ratings are ignored; without ratings every grade probability is that of a
flat model (expected grade 0, probability 1, nothing is rejected); with one
distinct grade every document gets that grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Joined, in_chunks, materialise, mix, text_bytes

HASH_BITS = 16
PROPORTIONS = 4
FIT_TASKS = 8
MAX_GRADES = 64


def _shape_table() -> np.ndarray:
    """Byte classes: a letter or any byte above ASCII 'a', a capital 'A', a digit '0', others themselves."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("a") : ord("z") + 1] = table[0x80:] = ord("a")
    table[ord("A") : ord("Z") + 1] = ord("A")
    table[ord("0") : ord("9") + 1] = ord("0")
    return table


SHAPE = _shape_table()


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, feature index, value) of all features of the texts."""
    mask = np.uint64((1 << HASH_BITS) - 1)
    plain = Joined([t.lower() for t in texts])
    starts, ends, text = plain.words()
    words = plain.hashes(starts, ends) & mask

    raw = Joined(texts)
    shape = SHAPE[raw.data]
    runs = np.ones(len(shape), bool)
    runs[1:] = shape[1:] != shape[:-1]
    short = Joined([])
    short.raw, short.data, short.ends = b"", shape[runs], np.array([runs.sum()])
    s, e, _ = short.words()
    shapes = mix(short.hashes(s, e) + np.uint64(1)) & mask

    n = np.bincount(text, minlength=len(texts))
    size = np.maximum(raw.ends - raw.starts, 1)
    share = lambda hit: (c := np.concatenate(([0], np.cumsum(hit))))[raw.ends] - c[raw.starts]
    capital, letter = share(shape == ord("A")), share((shape == ord("a")) | (shape == ord("A")))
    buckets = np.stack([
        np.log2(n + 1).astype(np.int64),
        8 * capital // size,
        20 * (size - letter) // size,
        np.minimum(size // np.maximum(n, 1), 31),
    ])
    proportions = mix((buckets + 1000 * np.arange(1, PROPORTIONS + 1)[:, None]).astype(np.uint64)) & mask
    each = (4.0 / np.maximum(n, 1))[text].astype(np.float32)
    return (np.concatenate([text, text, np.tile(np.arange(len(texts)), PROPORTIONS)]),
            np.concatenate([words, shapes, proportions.ravel()]).astype(np.int64),
            np.concatenate([each, each, np.full(PROPORTIONS * len(texts), 0.5, np.float32)]))


@dataclass(frozen=True)
class OrdinalModel:
    grades: tuple[int, ...]
    thresholds: tuple[float, ...]
    weights: np.ndarray

    def probabilities(self, margin: np.ndarray) -> np.ndarray:
        """P(grade = k) of each margin, one column for each grade."""
        below = _sigmoid(np.array(self.thresholds)[None, :] - margin[:, None])
        edges = np.column_stack([np.zeros(len(margin)), below, np.ones(len(margin))])
        return np.diff(edges, axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _thresholds(free: np.ndarray) -> np.ndarray:
    return free[0] + np.concatenate(([0], np.cumsum(np.exp(free[1:]))))


def loss_and_gradient(margin: np.ndarray, grade: np.ndarray, cuts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood, its derivative by each margin and by each threshold."""
    k = len(cuts)
    up = np.where(grade < k, cuts[np.minimum(grade, k - 1)] - margin, np.inf)
    low = np.where(grade > 0, cuts[np.maximum(grade - 1, 0)] - margin, -np.inf)
    su, sl = _sigmoid(up), _sigmoid(low)
    su[grade == k], sl[grade == 0] = 1, 0
    p = np.maximum(su - sl, 1e-12)
    du, dl = su * (1 - su) / p, sl * (1 - sl) / p
    by_cut = np.zeros(k)
    np.add.at(by_cut, grade[grade < k], -du[grade < k])
    np.add.at(by_cut, grade[grade > 0] - 1, dl[grade > 0])
    return float(-np.log(p).sum()), du - dl, by_cut


def _gradient_job(sample: DataFrame, n_cuts: int):
    """Function of the parameters: (loss, gradient) summed over the sample by Spark tasks."""
    size = 1 << HASH_BITS

    def evaluate(params: np.ndarray) -> tuple[float, np.ndarray]:
        ref = sample.sparkSession.sparkContext.broadcast(params)

        def run(batches):
            w, cuts = ref.value[n_cuts:], _thresholds(ref.value[:n_cuts])
            loss, grad, by_cut = 0.0, np.zeros(size), np.zeros(n_cuts)
            for batch in batches:
                grade = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                index, value = batch.column(1), batch.column(2)
                doc = np.repeat(np.arange(len(grade)), np.diff(index.offsets.to_numpy()))
                at, x = index.flatten().to_numpy(), value.flatten().to_numpy()
                margin = np.bincount(doc, weights=w[at] * x, minlength=len(grade))
                part, by_margin, cut = loss_and_gradient(margin, grade, cuts)
                loss, by_cut = loss + part, by_cut + cut
                grad += np.bincount(at, weights=by_margin[doc] * x, minlength=size)
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([np.concatenate([by_cut, grad]).tobytes()], pa.binary())], ["loss", "grad"])

        parts = sample.mapInArrow(run, "loss double, grad binary").collect()  # FIT_TASKS rows of a fixed size
        ref.unpersist()
        total = np.sum([np.frombuffer(r["grad"]) for r in parts], axis=0) if parts else np.zeros(n_cuts + size)
        free, by_cut = params[:n_cuts], total[:n_cuts]
        tail = np.cumsum(by_cut[::-1])[::-1]  # a gap moves all thresholds above it
        head = np.concatenate(([tail[0]], tail[1:] * np.exp(free[1:])))
        return float(sum(r["loss"] for r in parts)), np.concatenate([head, total[n_cuts:]])

    return evaluate


def lbfgs(evaluate, start: np.ndarray, rounds: int, memory: int = 8, tolerance: float = 1e-4) -> np.ndarray:
    """Minimise with limited-memory BFGS and backtracking."""
    x = start
    loss, grad = evaluate(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q = grad.copy()
        alphas = []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            alphas.append(a)
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(np.linalg.norm(grad), 1e-12)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        step, slope = 1.0, -(grad @ q)
        while True:
            new_x = x - step * q
            new_loss, new_grad = evaluate(new_x)
            if new_loss <= loss + 1e-4 * step * slope or step < 1e-4:
                break
            step /= 3
        s, y = new_x - x, new_grad - grad
        if new_loss >= loss:
            break
        if s @ y > 1e-10:
            pairs = [*pairs[-memory + 1 :], (s, y)]
        gain, x, loss, grad = loss - new_loss, new_x, new_loss, new_grad
        if gain < tolerance * max(loss, 1e-9):
            break
    return x


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality",
        max_fit_rows: int = 10_000, max_fit_chars: int = 50_000, penalty: float = 0.02, rounds: int = 40) -> OrdinalModel:
    """Fit on at most ``max_fit_rows`` rated documents of at most ``max_fit_chars`` characters."""
    rated = (ratings.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{grade_col}`").alias("grade")).dropna()
             .groupBy("id").agg(F.round(F.avg("grade")).cast("int").alias("grade")))
    chosen = rated.orderBy(F.xxhash64("id", F.lit("quality")), "id").limit(max_fit_rows)
    text = F.col(f"`{text_col}`")
    texts = docs.filter(F.length(text) <= max_fit_chars).select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("grade").alias("grade"))

    def hashed(batches):
        for batch in batches:
            own = text_bytes(batch.column(1))
            index, value, counts = [], [], np.zeros(len(own), np.int64)
            for a, b in in_chunks(own):
                doc, at, x = features(own[a:b])
                key, inverse = np.unique(doc << HASH_BITS | at, return_inverse=True)
                index.append(key & ((1 << HASH_BITS) - 1))
                value.append(np.bincount(inverse, weights=x, minlength=len(key)))
                counts[a:b] = np.bincount(key >> HASH_BITS, minlength=b - a)
            ends = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(index) if index else [], pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(np.concatenate(value) if value else [], pa.float32()))], ["grade", "at", "x"])

    ready = sample.select("grade", "text").repartition(FIT_TASKS).mapInArrow(hashed, "grade int, at array<int>, x array<float>")
    ready = materialise(ready, "quality-sample")
    counted = ready.groupBy("grade").agg(F.count("*").alias("n")).orderBy("grade").limit(MAX_GRADES + 1).collect()
    if len(counted) > MAX_GRADES:
        raise ValueError(f"more than {MAX_GRADES} distinct grades: ratings must be ordinal")
    grades = tuple(r["grade"] for r in counted)
    if len(grades) < 2:
        return OrdinalModel(grades or (0,), (), np.zeros(1 << HASH_BITS))
    coded = ready.select(F.element_at(F.create_map(*(F.lit(v) for k, g in enumerate(grades) for v in (g, k))), F.col("grade")).alias("grade"), "at", "x")
    shares = np.cumsum([r["n"] for r in counted])[:-1] / sum(r["n"] for r in counted)
    cuts = np.log(shares / (1 - shares))
    n_cuts = len(cuts)
    start = np.concatenate([[cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-3)), np.zeros(1 << HASH_BITS)])
    data_term = _gradient_job(coded, n_cuts)

    def penalised(params):
        loss, grad = data_term(params)
        w = params[n_cuts:]
        return loss + penalty * (w @ w), grad + np.concatenate([np.zeros(n_cuts), 2 * penalty * w])

    params = lbfgs(penalised, start, rounds)
    return OrdinalModel(grades, tuple(_thresholds(params[:n_cuts]).tolist()), params[n_cuts:])


def score(docs: DataFrame, model: OrdinalModel, select_grade: int | None = None, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """``docs`` with a struct column: expected_grade, tail_probability (grade >= ``select_grade``,
    by default the second lowest grade)."""
    ref = docs.sparkSession.sparkContext.broadcast(model)  # 2^HASH_BITS weights
    least = select_grade if select_grade is not None else model.grades[min(1, len(model.grades) - 1)]

    @F.arrow_udf("struct<expected_grade: double, tail_probability: double>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = ref.value
        values = np.array(m.grades, float)
        for column in columns:
            texts = text_bytes(column)
            margin = np.zeros(len(texts))
            for a, b in in_chunks(texts):
                doc, at, x = features(texts[a:b])
                margin[a:b] = np.bincount(doc, weights=m.weights[at] * x, minlength=b - a)
            p = m.probabilities(margin)
            yield pa.StructArray.from_arrays([pa.array(p @ values), pa.array(p[:, values >= least].sum(axis=1))], ["expected_grade", "tail_probability"])

    return docs.withColumn(out_col, run(F.col(f"`{text_col}`")))
