"""Corpus preparation as five Spark stages.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the documents that go on. Between stages the documents are written as
Parquet to the shared folder and read again. All stages but the last return the
columns of their input; the last returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialsift.llm import quality
from dialsift.llm.bpe_codec import encode
from dialsift.llm.common import materialise, numbered, table
from dialsift.llm.decontaminate import find_leaks
from dialsift.llm.line_dedup import line_dedup
from dialsift.llm.simhash import simhash_classes
from dialsift.session import ship_package

KEEP_PROBABILITY = 0.5
ROW = "__dialsift_row"
FOUND = "__dialsift_found"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose rating is likely above the lowest grade."""
    ship_package(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, out_col=FOUND)
    return scored.filter(F.col(f"{FOUND}.tail_probability") >= KEEP_PROBABILITY).select(*_names(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines found in ten or more of them."""
    ship_package(spark)
    out = line_dedup(docs, min_docs=10)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*_names(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class: the smallest doc_id, null ids last. Rows are told apart
    by their place in the stage's input files, the same in each of the three reads, so repeated and
    null ids are dropped like others."""
    ship_package(spark)
    rows = numbered(docs, ROW)
    classes = simhash_classes(rows, id_col=ROW)
    ranked = rows.select(ROW, "doc_id").join(classes, ROW)
    # rows meet their decision by row number, not by class: a class may hold a third of them
    first = ranked.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first"))
    dropped = ranked.select(ROW).join(first.select(f"first.{ROW}"), ROW, "left_anti")
    return rows.join(materialise(dropped, "dropped"), ROW, "left_anti").select(*_names(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_package(spark)
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"), out_col=FOUND)
    return found.filter(F.size(FOUND) == 0).select(*_names(docs))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip): token ids and whether they decode to the text."""
    ship_package(spark)
    coded = encode(docs.select("doc_id", "lang", "source", "text"), decoded_col="decoded")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def _names(docs: DataFrame):
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding and decoding", to_tokens),
]

# The fitted classifier, the fingerprints and the tokenizer have no SQL form;
# tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
