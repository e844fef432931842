"""Quality rules with cross-document line frequency, in DataFrame operations only.

Each text gives base counts (words, symbols, repeated lines, words in repeated windows) and one
64-bit hash for each line that has a word, after white space runs became one space and letters
lower case. Per host, the distinct documents that hold a line are counted; a line in at
least ``line_docs`` of them, and at least ``line_share`` of the host's, is boilerplate and is
removed from every document of the host. A document is rejected if its base counts fail or if
less than ``min_left`` of its line characters stays.

The text is read once: counts and line hashes go to the shared folder, and counting, the
depletion of documents and the verdict work on them. Exact copies in a host are one
document to the counts, so that a page copied a thousand times does not make its own
lines boilerplate. Line rows are counted per task before they shuffle. For the way back to the
documents, lines that hold over 1/1000 of all line rows (at most 1000 of them, whatever the input) are
broadcast, so that no key of the shuffled join has more than 1/1000 of the rows.

Defined cases: null text has no word, no line and fails the base rules; a null host is one host; each
input row is a document, ties and repeated rows alike; a document without lines loses nothing; an empty table
gives an empty table; a column of the input named like the result is replaced. Memory is in
proportion to the longest single text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered

WHITE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
HOT_SHARE = 1000  # a line with more than 1 in so many line rows is hot
HOST_SALTS = 16


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20  # of words in repeated windows
    window: int = 5
    line_docs: int = 10
    line_share: float = 0.001
    min_left: float = 0.2


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), WHITE, " "))


def _counts(rows: DataFrame, rules: Rules) -> DataFrame:
    """``rows`` (row, host, text) as (row, host, digest, five counts, lines of (h, chars))."""
    w = rules.window
    cut = rows.select(
        "row", "host", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("text", WHITE), lambda x: x != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, WHITE, " ")) != "").alias("raw_lines"))
    words = cut.select(
        "row", "host", "digest", "n_symbols", F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
        (F.size("raw_lines") - F.size(F.array_distinct("raw_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda x: F.xxhash64(x)).alias("hashes"),
        F.transform(F.transform("raw_lines", normalised), lambda x: F.struct(F.xxhash64(x).alias("h"), F.char_length(x).alias("chars"))).alias("lines"))
    span = words.withColumn("windows", F.when(F.size("hashes") >= w, F.transform(
        F.sequence(F.lit(0), F.size("hashes") - w), lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(w))))).otherwise(F.array().cast("array<long>")))
    # most texts repeat no window: only the others sort theirs
    pairs = span.withColumn("pairs", F.when(
        F.size("windows") > F.size(F.array_distinct("windows")),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))
    same = lambda p, i: F.get(F.col("pairs"), i)["h"].eqNullSafe(p["h"])
    twice = F.filter("pairs", lambda p, i: same(p, i + 1) | ((i > 0) & same(p, i - 1)))
    starts = pairs.withColumn("starts", F.sort_array(F.transform(twice, lambda p: p["at"])))
    covered = F.aggregate(
        F.transform("starts", lambda s, i: F.least(F.lit(w), F.coalesce(F.get("starts", i + 1) - s, F.lit(w)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    return starts.select("row", "host", "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), "lines")


def frequent_lines(base: DataFrame, rules: Rules) -> DataFrame:
    """(host, h, n_docs, n_rows): lines above both limits; n_docs counts distinct texts, n_rows documents.
    Written to the shared folder."""
    texts = base.groupBy("host", "digest").agg(F.count("*").alias("copies"), F.first("lines").alias("lines"))
    lines = texts.select("host", "copies", F.explode(F.array_distinct("lines.h")).alias("h"))
    counts = lines.groupBy("host", "h").agg(F.count("*").alias("n_docs"), F.sum("copies").alias("n_rows"))
    counts = counts.filter(F.col("n_docs") >= rules.line_docs)
    hosts = base.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    # a host may hold a third of the lines: its row meets them in salted parts
    hosts = hosts.withColumn("salt", F.explode(F.array(*map(F.lit, range(HOST_SALTS)))))
    met = counts.withColumn("salt", F.pmod("h", F.lit(HOST_SALTS)).cast("int")).join(hosts, ["host", "salt"])
    return materialise(met.filter(F.col("n_docs") >= F.col("host_docs") * rules.line_share).select("host", "h", "n_docs", "n_rows"), "frequent-lines")


def _lost(base: DataFrame, frequent: DataFrame) -> DataFrame:
    """(row, lost_chars, lost_lines, lost: hashes) of the documents that lose lines."""
    total = base.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("n")).first()["n"]
    hot = F.col("n_rows") * HOT_SHARE > total
    lines = base.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.*")
    few = F.broadcast(frequent.filter(hot).select("host", "h", F.lit(True).alias("hot")))  # fewer than HOT_SHARE rows
    marked = lines.join(few, ["host", "h"], "left")
    rest = marked.filter("hot IS NULL").join(frequent.filter(~hot).select("host", "h"), ["host", "h"])
    gone = marked.filter("hot").select("row", "h", "chars").unionByName(rest.select("row", "h", "chars"))
    return gone.groupBy("row").agg(F.sum("chars").alias("lost_chars"), F.count("*").alias("lost_lines"), F.collect_set("h").alias("lost"))


RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost_lines", "left_share", "kept")


def quality_rules(docs: DataFrame, rules: Rules = Rules(), host_col: str = "source", text_col: str = "text",
                  out_col: str = "rules") -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text_col`` and a struct ``out_col``: the counts of the
    text as it came, base_failed, n_lost_lines, left_share (characters of normalised lines that stay) and kept.

    Texts without a lost line stay byte for byte; a caller that does not select the text does not shuffle it."""
    row = "__rules_row"
    marked = numbered(docs, row)
    host = F.coalesce(F.concat(F.lit("="), F.col(f"`{host_col}`").cast("string")), F.lit(""))
    base = materialise(_counts(marked.select(
        F.col(row).alias("row"), host.alias("host"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")), rules), "rule-counts")
    lost = _lost(base, frequent_lines(base, rules))
    chars = F.aggregate("lines.chars", F.lit(0).cast("long"), lambda a, x: a + x)
    failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent)
    left = F.when(F.col("chars") > 0, 1 - F.coalesce("lost_chars", F.lit(0)) / F.col("chars")).otherwise(F.lit(1.0))
    verdicts = (base.withColumn("chars", chars).drop("lines").join(lost, "row", "left")
                .withColumn("base_failed", failed).withColumn("left_share", left)
                .withColumn("n_lost_lines", F.coalesce("lost_lines", F.lit(0).cast("long")))
                .withColumn("kept", ~F.col("base_failed") & (F.col("left_share") >= rules.min_left))
                .select(F.col("row").alias(row), F.struct(*RESULT).alias("__rules"), F.col("lost").alias("__lost")))
    text = F.col(f"`{text_col}`")
    cleaned = F.when(F.col("__lost").isNull(), text).otherwise(F.array_join(F.filter(
        F.split(text, "\n"), lambda x: (normalised(x) == "") | ~F.array_contains("__lost", F.xxhash64(normalised(x)))), "\n"))
    joined = marked.join(verdicts, row, "left").withColumn(text_col, cleaned).withColumn(out_col, F.col("__rules"))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns if c != out_col), F.col(f"`{out_col}`"))
