"""Queries of the text operators (``opN_<name>``) and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle, quality, toxicity
from .bpe_codec import encode
from .chat import CHATML, format_conversations, read_back
from .common import table
from .decontaminate import find_leaks
from .fill_in_middle import fill_in_middle, restore
from .line_dedup import line_dedup
from .minhash import fingerprint_documents
from .quality_rules import quality_rules
from .simhash import simhash_classes
from .spelling import count_words, group_variants
from .substring_dedup import substring_dedup
from .token_counts import count_tokens

CONTEXT_TOKENS = 1024
KEEP_PROBABILITY = 0.5
HELD_OUT = "pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) = 0"


def utf8_sha256(column):
    return F.sha2(F.coalesce(F.col(column), F.lit("")).cast("binary"), 256)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "quality_score.*", (F.col("quality_score.tail_probability") >= KEEP_PROBABILITY).alias("keep"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = f"{CHATML.close.strip()}{CHATML.opening}assistant ok"
    extra = spark.range(1).select(F.explode(F.array(
        *(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(n).alias("turn"), F.lit(role).alias("role"), F.lit(marks).alias("text"))
          for n, role in enumerate(("user", "assistant"))))).alias("x")).select("x.*")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_conversations(turns))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > CONTEXT_TOKENS)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of verified near copies (bands of the fingerprints joined, Jaccard verified) is a further column."""
    return fingerprint_documents(table(spark, sf_dir, "documents"), with_classes=True)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), out_col="cut")
    return cut.select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(f"NOT ({HELD_OUT})"))
    scored = toxicity.score(docs, model, out_col="score")
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, min_docs=10).select(
        "doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", utf8_sha256("text").alias("kept_sha256"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded_col="decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        utf8_sha256("decoded").alias("decoded_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and test item that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark")).filter(F.size("leaks") > 0)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*", F.lit(True).alias("contaminated"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", utf8_sha256("fim.text").alias("output_sha256"),
                      F.sha2(restore(F.col("fim.text"), F.col("fim.form")).cast("binary"), 256).alias("restored_sha256"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = quality_rules(table(spark, sf_dir, "documents"))
    return ruled.select("doc_id", *(f"rules.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_one_in=97))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_simhash": op2_simhash,
    "op3_chat_format": op3_chat_format,
    "op4_token_counts": op4_token_counts,
    "op5_minhash": op5_minhash,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_decontaminate": op10_decontaminate,
    "op11_fim": op11_fim,
    "op12_quality_rules": op12_quality_rules,
    "op13_spelling": op13_spelling,
}

ORACLE: dict[str, str] = {
    "op3_chat_format": oracle.CHAT_FORMAT,
    "op8_line_dedup": oracle.LINE_DEDUP,
    "op11_fim": oracle.FIM,
    "op12_quality_rules": oracle.QUALITY_RULES,
}
