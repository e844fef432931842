"""Quality and toxicity: likelihood, gradients, held-out accuracy, awkward input."""

import random

import numpy as np
from pyspark.sql import functions as F

from dialsift.llm import quality, toxicity

from .conftest import AWKWARD


def auc(score, label):
    score, label = np.array(score), np.array(label)
    pos, neg = score[label == 1], score[label == 0]
    return float(((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean())


def test_ordinal_gradient():
    gen = np.random.default_rng(1)
    cuts, margin, grade = np.array([-1.0, 0.3, 1.2]), gen.normal(size=40), gen.integers(0, 4, 40)
    loss, by_margin, by_cut = quality.loss_and_gradient(margin, grade, cuts)
    for k in range(40):
        step = np.eye(40)[k] * 1e-6
        assert abs((quality.loss_and_gradient(margin + step, grade, cuts)[0] - loss) / 1e-6 - by_margin[k]) < 1e-4
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        assert abs((quality.loss_and_gradient(margin, grade, cuts + step)[0] - loss) / 1e-6 - by_cut[k]) < 1e-4


def test_lbfgs_finds_the_minimum():
    a = np.diag([1.0, 10.0, 100.0])
    x = quality.lbfgs(lambda v: (float(v @ a @ v / 2 - v.sum()), a @ v - 1), np.zeros(3), 60, tolerance=1e-14)
    assert np.allclose(x, [1, 0.1, 0.01], atol=1e-4)


def graded(n=600, seed=3):
    rnd = random.Random(seed)
    rows, grades = [], []
    for k in range(n):
        g = rnd.randrange(4)
        rows.append((k, " ".join(rnd.choice(["good", "fine"]) if rnd.random() < g / 4 else rnd.choice(["spam!!", "CLICK"]) if rnd.random() < 0.4 else f"w{rnd.randrange(300)}"
                                 for _ in range(rnd.randint(20, 60)))))
        grades.append((k, g))
    return rows, grades


def test_four_ordered_grades(spark, written):
    rows, grades = graded()
    train = spark.createDataFrame([g for g in grades if g[0] % 4], "doc_id long, quality int")
    model = quality.fit(written(rows), train)
    assert model.grades == (0, 1, 2, 3) and list(model.thresholds) == sorted(model.thresholds)
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(written(rows), model, select_grade=2).collect()}
    held = [(got[k], g) for k, g in grades if k % 4 == 0]
    assert np.corrcoef([s["expected_grade"] for s, _ in held], [g for _, g in held])[0, 1] > 0.8
    assert auc([s["tail_probability"] for s, _ in held], [int(g >= 2) for _, g in held]) > 0.9
    again = quality.fit(written(rows), train)
    assert np.allclose(again.weights, model.weights, atol=1e-6)  # whatever the partitioning


def test_quality_without_ratings_and_awkward_rows(spark, written):
    docs = written(AWKWARD)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    flat = quality.score(docs, quality.fit(docs, none)).select("quality_score.*").collect()
    assert len(flat) == len(AWKWARD) and {tuple(r) for r in flat} == {(0.0, 1.0)}
    one = spark.createDataFrame([(4, 1), (5, 1)], "doc_id long, quality int")
    assert {r[0] for r in quality.score(docs, quality.fit(docs, one)).select("quality_score.expected_grade").collect()} == {1.0}
    mixed = spark.createDataFrame([(2, 0), (4, 1), (5, 1), (5, 0), (11, 0), (8, 1)], "doc_id long, quality int")
    scores = quality.score(docs, quality.fit(docs, mixed)).select("quality_score.*").collect()
    assert len(scores) == len(AWKWARD) and all(0 <= r["tail_probability"] <= 1 for r in scores)
    assert quality.score(written([], parts=1), quality.fit(docs, mixed)).count() == 0


def toxic_corpus(n=900, seed=8):
    rnd = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = ["".join(rnd.choice(["an", "the", "re", "ing", "tion", "er", "on", "st"]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(30, 150))]
        bad = rnd.random() < 0.2
        if bad:
            for _ in range(rnd.randint(2, 5)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["Scumbag", "worthless", "pathetic", "disgusting"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark, written):
    rows, labels = toxic_corpus()
    train = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, toxic int")
    model = toxicity.fit(written(rows), train)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(written(rows), model).collect()}
    held = [(got[k], y) for k, y in labels if k % 5 == 0]
    assert auc([s for s, _ in held], [y for _, y in held]) > 0.95
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.9


def test_windows_cover_the_text():
    for text in (b"", b"  ", b"a", b"a b " * 200, b"x" * 5000, b"y" * 100 + b" z"):
        assert b"".join(toxicity.windows(text)).replace(b" ", b"") == b"".join(text.split())
        assert all(len(w) <= 4 * toxicity.WINDOW for w in toxicity.windows(text))


def test_toxicity_defined_cases(spark, written):
    docs = written(AWKWARD)
    for labels, expected in (([(1, None)], 0.0), ([(1, 1), (4, 1)], 1.0), ([(4, 0), (5, 0)], 0.0)):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        scores = [r[0] for r in toxicity.score(docs, model).select(F.round("toxicity", 6)).collect()]
        assert len(scores) == len(AWKWARD) and set(scores) == {expected}
    few = toxicity.fit(docs, spark.createDataFrame([(4, 0), (5, 1), (5, 0), (11, 1)], "doc_id long, toxic int"))
    assert all(0 <= r["toxicity"] <= 1 for r in toxicity.score(docs, few).collect())
    assert toxicity.score(written([], parts=1), few).count() == 0


def test_quality_equals_a_plain_dense_model(spark, written):
    """Scores from weights and thresholds by the plain cumulative-link formula; the fit lowers the plain objective."""
    import math

    rows, grades = graded(160, seed=5)
    model = quality.fit(written(rows), spark.createDataFrame(grades, "doc_id long, quality int"), penalty=0.02)
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    known = []
    for _, text in rows:
        _, at, x = quality.features([text.encode()])
        dense = {}
        for k, v in zip(at.tolist(), x.tolist(), strict=True):
            dense[k] = dense.get(k, 0.0) + v
        known.append(dense)

    def shares(dense, weights, cuts):
        margin = sum(weights[k] * v for k, v in dense.items())
        below = [0.0, *(sigmoid(c - margin) for c in cuts), 1.0]
        return [b - a for a, b in zip(below, below[1:], strict=False)]

    got = {r["doc_id"]: r["quality_score"] for r in quality.score(written(rows), model, select_grade=2).collect()}
    for (i, _), dense in zip(rows, known, strict=True):
        p = shares(dense, model.weights, model.thresholds)
        assert abs(got[i]["expected_grade"] - sum(g * v for g, v in zip(model.grades, p, strict=True))) < 1e-6
        assert abs(got[i]["tail_probability"] - sum(v for g, v in zip(model.grades, p, strict=True) if g >= 2)) < 1e-6

    def objective(weights, cuts):
        loss = -sum(math.log(max(shares(d, weights, cuts)[g], 1e-300)) for d, (_, g) in zip(known, grades, strict=True))
        return loss + 0.02 * float(weights @ weights)

    best = objective(model.weights, model.thresholds)
    used = sorted({k for d in known for k in d})
    rng = np.random.default_rng(0)
    assert best < objective(np.zeros_like(model.weights), model.thresholds)
    for _ in range(5):
        step = np.zeros_like(model.weights)
        step[used] = rng.normal(size=len(used)) * 0.05
        assert objective(model.weights + step, model.thresholds) > best
    for shift in (0.3, -0.3):
        assert objective(model.weights, [c + shift for c in model.thresholds]) > best


def test_toxicity_scores_recomputed_plainly(spark, written):
    """Bytes that the toxic dictionary saves on each window of about 64 bytes, then the logistic calibration."""
    import math

    import zstandard

    rows, labels = toxic_corpus(300)
    base, toxic, weights = model = toxicity.fit(written(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert base and toxic.startswith(base)

    def length(window, dictionary):
        params = zstandard.ZstdCompressionParameters.from_level(3, source_size=64, dict_size=len(dictionary), min_match=6, write_content_size=False,
                                                                write_checksum=False, write_dict_id=False)
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, zstandard.DICT_TYPE_RAWCONTENT),
                                            compression_params=params).compress(window))

    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(written(rows), model).collect()}
    for i, text in rows[::30]:
        parts, words = [], []
        for word in text.lower().encode().split():
            words.append(word)
            if sum(len(w) + 1 for w in words) >= 64:
                parts.append(b" " + b" ".join(words))
                words = []
        if words:
            parts.append(b" " + b" ".join(words))
        saved = sorted((length(w, base) - length(w, toxic) for w in parts), reverse=True)
        top = saved[:3]
        z = weights[0] * saved[0] + weights[1] * sum(top) / len(top) + weights[2] * sum(saved) / len(saved) + weights[3]
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
