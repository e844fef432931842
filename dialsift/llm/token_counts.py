"""Token counts without ids.

1. Every distinct pre-token of the corpus is counted into pieces once.
2. Each document becomes its pre-token frequencies. Those of the most frequent
   pre-tokens (a bounded number, those of over 64 bytes by their digest) are multiplied by their broadcast piece counts
   on the spot; the others travel as (document, pre-token, frequency) and
   are joined to the piece counts in a shuffle.
3. The products are summed by document. No token ids are materialised.

Defined cases: null or empty text has 0 bytes and 0 tokens; a special string of
the vocabulary inside a text is one token, as the tokenizers library counts by
default; every input row is counted on its own, also with an equal or null id.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .bpe_codec import SHORT_BYTES, count_words, most_frequent
from .common import materialise, text_list


LONG_SHARE = 10  # one long pre-token in the broadcast for so many short ones


def count_pieces(docs: DataFrame, vocabulary, text_col: str = "text") -> DataFrame:
    """(word, n, pieces): occurrences and number of tokens of each distinct pre-token."""

    def run(batches):
        merge = bpe.load(vocabulary).merge
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(merge(w)) for w in words], pa.int32())], ["word", "n", "pieces"])

    return materialise(count_words(docs, vocabulary, text_col).mapInArrow(run, "word string, n long, pieces int"), "piece-counts")


def _digest(word: str) -> bytes:
    return hashlib.sha256(word.encode()).digest()


def _frequencies(vocabulary, frequent_ref):
    """Per document: bytes, tokens of frequent pre-tokens, and the other pre-tokens with their frequencies."""

    def run(batches):
        model, frequent = bpe.load(vocabulary), frequent_ref.value
        for batch in batches:
            n_bytes, tokens, words, freqs = [], [], [], []
            for text in text_list(batch.column(2)):
                n_bytes.append(len(text.encode()))
                total, rest = 0, {}
                for piece, f in Counter(model.pieces(text) if text else ()).items():
                    if (pieces := frequent.get(piece)) is not None:  # the piece is one frequent pre-token
                        total += f * pieces
                        continue
                    for word in model.piece_words(piece):
                        pieces = 1 if isinstance(word, int) else frequent.get(word)
                        if pieces is None and len(word) > SHORT_BYTES // 4:  # a long one is known by its digest
                            pieces = frequent.get(_digest(word))
                        if pieces is None:
                            rest[word] = rest.get(word, 0) + f
                        else:
                            total += f * pieces
                tokens.append(total)
                words.append(list(rest))
                freqs.append(list(rest.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array(words, pa.list_(pa.string())), pa.array(freqs, pa.list_(pa.int64()))],
                ["row", "id", "n_bytes", "head", "words", "freqs"])

    return run


def count_tokens(docs: DataFrame, path: str | None = None, frequent_words: int = 200_000, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(<id_col>, n_bytes, n_tokens) for every row of ``docs``.

    ``frequent_words`` bounds the broadcast; it does not change a count."""
    spark = docs.sparkSession
    vocabulary = bpe.read_vocabulary(spark, path)
    pieces = count_pieces(docs, vocabulary, text_col)
    words = most_frequent(pieces, frequent_words).select("word", "pieces").toArrow()
    head = dict(zip(words.column(0).to_pylist(), words.column(1).to_pylist(), strict=True))
    # a ruler of 80 dashes may be in every document: long pre-tokens are sent as digests
    rulers = most_frequent(pieces, frequent_words // LONG_SHARE, longer=True)
    rulers = rulers.select(F.unhex(F.sha2(F.col("word").cast("binary"), 256)).alias("digest"), "pieces").toArrow()
    head |= zip(rulers.column(0).to_pylist(), rulers.column(1).to_pylist(), strict=True)
    frequent = spark.sparkContext.broadcast(head)
    id_type = docs.select(F.col(f"`{id_col}`")).dtypes[0][1]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    per_doc = materialise(rows.mapInArrow(
        _frequencies(vocabulary, frequent), f"row long, id {id_type}, n_bytes long, head long, words array<string>, freqs array<long>"),
        "pre-token-frequencies")
    rare = per_doc.select("row", F.explode(F.arrays_zip("words", "freqs")).alias("x")).select("row", F.col("x.words").alias("word"), "x.freqs")
    rare = rare.join(pieces.select("word", "pieces"), "word").select("row", (F.col("freqs") * F.col("pieces")).alias("tokens"))
    parts = per_doc.select("row", "id", "n_bytes", F.col("head").alias("tokens")).unionByName(rare, allowMissingColumns=True)
    return (parts.groupBy("row").agg(F.max("id").alias(id_col), F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
            .drop("row"))
