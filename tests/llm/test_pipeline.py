"""Every stage of the pipeline against brute force, and on awkward input."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from dialsift.llm import bpe, quality, simhash
from dialsift.llm.common import materialise, numbered

from .conftest import AWKWARD
from .test_line_dedup import brute as dropped_lines
from .test_simhash import classes, fingerprint

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark):
    """A small data folder: junk and clean documents, copies, common lines and leaks."""
    rnd = random.Random(9)
    items = [" ".join(f"q{rnd.randrange(9999)}" for _ in range(20)) for _ in range(5)]
    rows, labels = [], []
    for k in range(240):
        words = [f"w{rnd.randrange(4000)}" for _ in range(rnd.randint(30, 90))]
        junk = k % 6 == 0
        text = " ".join(w.upper() + "!!" if junk else w for w in words)
        if k % 5 == 1:
            text += "\nAll rights reserved"
        if k % 10 == 2:
            text += " " + items[k % 5]
        if k % 8 == 3 and rows:
            text = rows[k // 2][1]
        rows.append((k, text, "en", "s", len(text)))
        labels.append((k, 0 if junk and k % 8 != 3 else 1, 0))
    base = os.path.join(spark.sparkContext.getCheckpointDir(), f"corpus-{uuid.uuid4().hex}")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, items


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_equal_brute_force(spark, folder):
    base, items = folder
    docs = spark.read.parquet(f"{base}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]

    kept = materialise(stage["quality classifier"](spark, docs, base), "t")
    model = quality.fit(docs, spark.read.parquet(f"{base}/labels.parquet"))
    scored = quality.score(docs, model).collect()
    assert sorted(rows_of(kept)) == sorted((r["doc_id"], r["text"]) for r in scored if r["quality_score"]["tail_probability"] >= 0.5)
    junk = {r["doc_id"] for r in docs.collect() if "!!" in r["text"]}
    ids = {i for i, _ in rows_of(kept)}
    assert len(ids & junk) <= 2 and len(ids) >= docs.count() - len(junk) - 2
    before = rows_of(kept)

    lines = materialise(stage["line dedup"](spark, kept, base), "t")
    assert sorted(rows_of(lines)) == sorted((i, t) for i, t, *_ in dropped_lines(before, 10))
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect()) and not any("rights" in t for _, t in rows_of(lines))
    before = rows_of(lines)

    unique = materialise(stage["SimHash near-dedup"](spark, lines, base), "t")
    component = classes([i for i, _ in before], [fingerprint(t) for _, t in before])
    assert sorted(i for i, _ in rows_of(unique)) == sorted({i for (i, _), c in zip(before, component, strict=True) if i == c})
    before = rows_of(unique)

    clean = materialise(stage["benchmark decontamination"](spark, unique, base), "t")
    assert sorted(rows_of(clean)) == sorted((i, t) for i, t in before if not any(x in t for x in items))
    for df in (kept, lines, unique, clean):
        assert df.columns == docs.columns

    tokens = stage["BPE encoding and decoding"](spark, clean, base)
    library = Tokenizer.from_file(bpe.default_path())
    texts = dict(rows_of(clean))
    got = tokens.collect()
    assert len(got) == len(texts) and all(r["round_trip"] for r in got)
    assert all(r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) for r in got)

    whole = corpus_pipeline.run(spark, base)
    assert sorted((r["doc_id"], r["ids"]) for r in whole.collect()) == sorted((r["doc_id"], r["ids"]) for r in got)


@pytest.mark.parametrize("rows", [AWKWARD, []])
def test_awkward_and_empty_stages(spark, folder, rows):
    base, _ = folder
    path = os.path.join(spark.sparkContext.getCheckpointDir(), f"odd-{uuid.uuid4().hex}")
    full = [(i, t, None, None, None, "x", 1) for i, t in rows]
    spark.createDataFrame(full, DOCS + ", fp string, found int").repartition(2).write.parquet(path)
    docs = spark.read.parquet(path)
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, base), "t")
        if name != "BPE encoding and decoding":
            assert out.columns == docs.columns
        if name == "SimHash near-dedup" and rows:
            same = out.filter(F.col("text") == "same text here for you").collect()
            assert [r["doc_id"] for r in same] == [10]
            assert out.filter("coalesce(trim(text), '') = ''").count() <= 2
        elif name != "quality classifier":
            assert out.count() == docs.count()
        elif not rows:
            assert out.count() == 0


def near_copies(n=400):
    """Rows (doc_id, text, lang, source, n_chars) of which every second repeats the text of a lower id."""
    texts = [" ".join(f"t{k}x{j}" for j in range(30)) for k in range(n // 2)]
    return [(k, texts[k % (n // 2)], "en", "s", len(texts[k % (n // 2)])) for k in range(n)]


def test_near_copies_when_the_files_are_packed_anew(spark, written, repacked):
    rows = near_copies()
    docs = written(rows, DOCS, parts=5)
    repacked(simhash)
    repacked(corpus_pipeline)
    out = materialise(corpus_pipeline.drop_near_copies(spark, docs, ""), "t")
    assert sorted(rows_of(out)) == [r[:2] for r in rows[: len(rows) // 2]]


def test_row_numbers(spark, written):
    docs = written(near_copies(), DOCS, parts=5)
    frames = {
        "table": docs, "projection": docs.select("doc_id", "text"), "filter": docs.filter("doc_id % 3 = 0"), "twice": docs.union(docs),
        "same path twice": spark.read.parquet(*2 * docs.select("_metadata.file_path").distinct().toPandas()["file_path"].tolist()),
        "exploded": docs.select("doc_id", F.explode(F.array("text", "lang")).alias("text")), "own metadata": docs.withColumn("_metadata", F.lit(1)),
        "no file": spark.range(50), "empty": written([], DOCS, parts=1)}
    for name, df in frames.items():
        rows = numbered(df, "no")
        assert rows.columns == [*df.columns, "no"], name
        seen = rows.select("no", df.columns[0]).collect()
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        again = rows.select("no", df.columns[0]).collect()
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
        assert len({r["no"] for r in seen}) == len(seen) == df.count() and sorted(seen) == sorted(again), name


def test_short_items_reach_the_pipeline(spark, written):
    base = os.path.join(spark.sparkContext.getCheckpointDir(), f"short-{uuid.uuid4().hex}")
    spark.createDataFrame([(1, "alpha beta"), (2, "zeta eta theta iota")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    docs = written([(k, t, "en", "s", len(t)) for k, t in enumerate(["beta alpha", "an Alpha, beta b", "zeta eta theta", "zeta eta theta iota"])], DOCS)
    assert sorted(rows_of(corpus_pipeline.drop_leaks(spark, docs, base))) == [(0, "beta alpha"), (2, "zeta eta theta")]
