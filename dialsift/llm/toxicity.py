"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, and one on the
fragments of toxic texts that ordinary texts (nearly) lack, laid after the
ordinary one. A window of about 64 bytes, cut at words, is compressed with both;
the bytes that the toxic dictionary saves are its distance. A document is
scored from its windows' distances (largest, mean of the three largest, mean)
by a logistic calibration fitted on labelled documents that trained no dictionary.

The fit uses a bounded sample of the labelled rows (``max_toxic``, ``max_ordinary`` documents of at
most ``max_fit_chars`` characters) in one executor task; scoring covers every
window of every whole text.

Defined cases: null, empty or word-less text has distance 0; without labelled
rows of both classes every score is the share of toxic labels (0 without labels); a
document with several labels is toxic if any of them says so; null labels are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

WINDOW = 64
BASE_BYTES, TOXIC_BYTES = 64 << 10, 4 << 10
LEVEL, MIN_MATCH = 3, 6
MIN_SHARE = 0.02  # of toxic documents that hold a fragment
MAX_RATIO = 0.03  # of its share among ordinary documents to that among toxic ones
FRAGMENT = re.compile(rb"[^\s!-/:-@\[-`{-~]+")


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """Consecutive words of at least ``size`` bytes together; a longer word is cut."""
    out, words, length = [], [], 0
    for word in text.lower().split():
        words.append(word)
        length += len(word) + 1
        if length >= size:
            piece = b" " + b" ".join(words)
            out += [piece] if length <= 4 * size else [piece[k : k + size] for k in range(0, len(piece), size)]
            words, length = [], 0
    if words:
        out.append(b" " + b" ".join(words))
    return out


def _trained(size: int, samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their text itself
        return b" ".join(dict.fromkeys(samples))[-size:]


def _fragments(text: bytes) -> list[bytes]:
    return [w for w in FRAGMENT.findall(text.lower()) if len(w) > 3]


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary contents."""
    base = _trained(BASE_BYTES, [w for t in ordinary for w in windows(t, 2048)])
    in_toxic = Counter(w for t in toxic for w in set(_fragments(t)))
    in_ordinary = Counter(w for t in ordinary for w in set(_fragments(t)))
    least = max(2, MIN_SHARE * len(toxic))
    marked = {w for w, n in in_toxic.items() if n >= least and (in_ordinary[w] + 0.5) / len(ordinary) < MAX_RATIO * n / len(toxic)}
    samples = [b" ".join(w for w in _fragments(t) if w in marked) for t in toxic]
    return base, base + _trained(TOXIC_BYTES, [s for s in samples if len(s) >= 8])


class Distances:
    def __init__(self, base: bytes, toxic: bytes) -> None:
        self.compressors = [self._compressor(d) for d in (base, toxic)]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=WINDOW, dict_size=len(content), min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
        return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)

    def features(self, text: bytes) -> tuple[float, float, float]:
        plain, toxic = (c.compress for c in self.compressors)
        saved = sorted(len(plain(w)) - len(toxic(w)) for w in windows(text))
        if not saved:
            return 0.0, 0.0, 0.0
        top = saved[-3:]
        return float(saved[-1]), sum(top) / len(top), sum(saved) / len(saved)


def _calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the intercept is last and unpenalised."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


MODEL = "base binary, toxic binary, weights array<double>"


def _fit(batches):
    """One task over the bounded sample: rows (text, label, part) with part 0 to calibrate on."""
    texts, labels, parts = [], [], []
    for batch in batches:
        texts += text_bytes(batch.column(0))
        labels += batch.column(1).to_pylist()
        parts += batch.column(2).to_pylist()
    labels, parts = np.array(labels, bool), np.array(parts, np.int64)
    rate = float(labels.mean()) if len(labels) else 0.0
    pick = lambda rows: [texts[k] for k in np.flatnonzero(rows)]
    if not labels.any() or labels.all():
        base = toxic = b""
        weights = [0.0, 0.0, 0.0, float(np.clip(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9)), -30, 30))]
    else:
        trains = parts != 0
        if not (labels & trains).any() or not (~labels & trains).any() or len(set(labels[~trains].tolist())) < 2:
            trains = np.ones(len(labels), bool)  # too few rows to keep some apart
        base, toxic = train_dictionaries(pick(labels & trains), pick(~labels & trains))
        rest = ~trains if not trains.all() else trains
        distances = Distances(base, toxic)
        weights = _calibrate(np.array([distances.features(t) for t in pick(rest)]), labels[rest].astype(float)).tolist()
    yield pa.RecordBatch.from_arrays([pa.array([base], pa.binary()), pa.array([toxic], pa.binary()), pa.array([weights], pa.list_(pa.float64()))],
                                     ["base", "toxic", "weights"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_toxic: int = 4000, max_ordinary: int = 8000, max_fit_chars: int = 20_000) -> tuple[bytes, bytes, list[float]]:
    """(ordinary dictionary, toxic dictionary, calibration weights) from the labelled documents."""
    spark = docs.sparkSession
    rated = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).dropna().groupBy("id").agg(F.max("label").alias("label"))
    text, spread = F.col(f"`{text_col}`"), F.xxhash64("id", F.lit("toxicity"))
    rated = rated.withColumn("spread", spread)
    sample = None
    for part, most in ((F.col("label") > 0, max_toxic), (F.col("label") <= 0, max_ordinary)):
        chosen = rated.filter(part).orderBy("spread", "id").limit(most)
        sample = chosen if sample is None else sample.unionByName(chosen)
    texts = docs.filter(F.length(text) <= max_fit_chars).select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    rows = texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("spread").alias("spread"))
    rows = rows.select("text", (F.col("label") > 0).alias("label"), F.pmod(F.shiftright("spread", 8), F.lit(4)).alias("part"))
    model = rows.coalesce(1).mapInArrow(_fit, MODEL).first()
    if model is None:  # no labelled document
        return b"", b"", [0.0, 0.0, 0.0, -30.0]
    return bytes(model["base"]), bytes(model["toxic"]), list(model["weights"])


def score(docs: DataFrame, model: tuple[bytes, bytes, list[float]], text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with ``out_col`` double from 0 to 1."""
    base, toxic, weights = model
    ref = docs.sparkSession.sparkContext.broadcast((base, toxic))  # two dictionaries of fixed size

    @F.arrow_udf("double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        distances = Distances(*ref.value)
        w = np.array(weights)
        for column in columns:
            x = np.array([distances.features(t) for t in text_bytes(column)]).reshape(-1, 3)
            yield pa.array(1 / (1 + np.exp(-np.clip(x @ w[:3] + w[3], -30, 30))), pa.float64())

    return docs.withColumn(out_col, run(F.col(f"`{text_col}`")))
