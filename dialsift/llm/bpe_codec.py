"""BPE encoding and decoding of a text column.

Pass 1 counts the pre-tokens of all documents; the most frequent (a documented number) are compiled with their ids into a minimal
acyclic transducer, shipped to the executors as a Spark file and mapped into
memory. Pass 2 looks every distinct pre-token of every document up in the transducer and
merges the unseen ones exactly. The lexicon changes speed only, never ids.

Defined cases: null or empty text has no ids; special strings of the
vocabulary inside a text are their ids, as the tokenizers library does by
default; ids outside the vocabulary decode to nothing; null ids decode to an
empty text; rows keep all their columns (an input column named like an output
column is replaced).
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import materialise, text_list
from .transducer import Transducer, compile_words

CHUNK_CHARS = 1 << 20
FLUSH_WORDS = 150_000
INDEX_WORDS = 500_000
SHORT_BYTES = 64
COUNT_STEPS = 16  # count classes for each doubling


def count_words(docs: DataFrame, vocabulary: Broadcast, text_col: str = "text") -> DataFrame:
    """(word, n): pre-tokens of all texts, pre-aggregated in each task."""

    def run(batches):
        model = bpe.load(vocabulary)
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(model.pieces(text))
                if len(counts) > FLUSH_WORDS:
                    yield _counted(model, counts)
                    counts = Counter()
        yield _counted(model, counts)

    counted = docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(model: bpe.Bpe, pieces: Counter) -> pa.RecordBatch:
    counts: Counter = Counter()
    for piece, n in pieces.items():
        for word in model.piece_words(piece):
            if isinstance(word, str):
                counts[word] += n
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def most_frequent(counted: DataFrame, most: int, longer: bool = False) -> DataFrame:
    """The rows (word, n, ...) of the highest count classes that hold ``most`` words at most
    together: a filter, so no task and not the driver sorts candidates. Words of over
    SHORT_BYTES bytes are left out, which bounds the bytes as well; ``longer`` takes only these."""
    bytes_ = F.octet_length("word")
    short = counted.filter(bytes_ > SHORT_BYTES if longer else bytes_ <= SHORT_BYTES).withColumn("class", F.floor(F.log2("n") * COUNT_STEPS))
    sizes = short.groupBy("class").count().orderBy(F.desc("class")).collect()  # 64 * COUNT_STEPS rows at most
    total, least = 0, None
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        least = r["class"]
    return short.filter(F.lit(False) if least is None else F.col("class") >= least).drop("class")


_LEXICONS = []  # folders of the shipped files, removed at the end of the driver


def build_lexicon(docs: DataFrame, vocabulary: Broadcast, lexicon_words: int, text_col: str = "text") -> str:
    """Compile the most frequent pre-tokens of all documents and ship the file; its name."""
    spark = docs.sparkSession
    words = most_frequent(materialise(count_words(docs, vocabulary, text_col), "word-counts"), lexicon_words).select("word").toArrow()
    merge = bpe.load(vocabulary).merge
    image = compile_words((w.encode(), array("i", merge(w))) for w in words.column(0).to_pylist())
    name = f"lexicon-{hashlib.sha256(image).hexdigest()[:24]}.bin"
    if not any(f.endswith(f"/{name}") for f in spark.sparkContext.listFiles):  # named by content
        _LEXICONS.append(tempfile.TemporaryDirectory(prefix="dialsift-lexicon-"))
        path = os.path.join(os.path.realpath(_LEXICONS[-1].name), name)
        with open(path, "wb") as f:
            f.write(image)
        spark.sparkContext.addFile(path)  # from the driver to every executor
    return name


@lru_cache(maxsize=2)
def _mapped(path: str) -> Transducer:
    return Transducer(path)


class _Store:
    """Integer lists, numbered as they come."""

    def __init__(self) -> None:
        self.start, self.values, self.used = np.zeros(1, np.int64), np.empty(1 << 12, np.int32), 0

    def add(self, lens: np.ndarray, values: np.ndarray) -> None:
        total = self.used + len(values)
        if total > len(self.values):
            self.values = np.concatenate([self.values[: self.used], np.empty(2 * total - self.used, np.int32)])
        self.values[self.used : total] = values
        self.start, self.used = np.concatenate([self.start, self.used + np.cumsum(lens)]), total

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, values) of the lists with these numbers, one after another."""
        begin = self.start[numbers]
        lens = self.start[numbers + 1] - begin
        return lens, self.values[np.repeat(begin, lens) + _within(lens)]


class Encoder:
    """Transducer first, exact merging for the rest; the pieces and words of a task are looked
    up once while they fit in the index, which is bounded."""

    def __init__(self, model: bpe.Bpe, lexicon: Transducer) -> None:
        self.model, self.lexicon = model, lexicon
        self._reset()

    def _reset(self) -> None:
        self.pieces: dict[str | int, int] = {}  # to the numbers of their words
        self.piece_words = _Store()
        self.words: dict[str | int, int] = {}  # to their ids
        self.word_ids = _Store()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts."""
        if len(self.pieces) > INDEX_WORDS:
            self._reset()
        index, known = self.pieces, len(self.pieces)
        codes, counts = [], []
        for text in texts:
            found = self.model.pieces(text) if text else []
            codes += [index.setdefault(w, len(index)) for w in found]
            counts.append(len(found))
        self._learn(list(islice(index, known, None)))
        n_words, words = self.piece_words.get(np.asarray(codes, np.int64))
        n_ids, ids = self.word_ids.get(words)
        ends = np.concatenate(([0], np.cumsum(n_ids)))
        return ends[np.concatenate(([0], np.cumsum(n_words)))[np.cumsum([0, *counts])]], ids

    def _learn(self, pieces: list[str | int]) -> None:
        """Append the words of new pieces and the ids of new words."""
        index, known = self.words, len(self.words)
        lens, numbers = [], []
        for piece in pieces:
            found = self.model.piece_words(piece)
            if len(found) == 1:
                found[0] = piece  # one string for both indexes
            lens.append(len(found))
            numbers += [index.setdefault(w, len(index)) for w in found]
        self.piece_words.add(np.asarray(lens, np.int64), np.asarray(numbers, np.int32))
        new = list(islice(index, known, None))
        ranks = self.lexicon.ranks([w.encode() if isinstance(w, str) else b"\xff" for w in new])
        seen = ranks >= 0
        merged = [[w] if isinstance(w, int) else self.model.merge(w) for w, s in zip(new, seen.tolist(), strict=True) if not s]
        first = self.lexicon.id_start[ranks[seen]].astype(np.int64)
        lens = np.empty(len(new), np.int64)
        lens[seen] = self.lexicon.id_start[ranks[seen] + 1] - first
        lens[~seen] = [len(m) for m in merged]
        ids = np.empty(int(lens.sum()), np.int32)
        begin = np.cumsum(lens) - lens
        within = _within(lens[seen])
        ids[np.repeat(begin[seen], lens[seen]) + within] = self.lexicon.ids[np.repeat(first, lens[seen]) + within]
        rest = lens[~seen]
        ids[np.repeat(begin[~seen], rest) + _within(rest)] = np.fromiter((i for m in merged for i in m), np.int32, int(rest.sum()))
        self.word_ids.add(lens, ids)


def _within(lens: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each length n, one after another."""
    ends = np.cumsum(lens)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lens, lens)


def _text_chunks(texts: list[str]) -> Iterator[list[str]]:
    chunk, size = [], 0
    for t in texts:
        chunk.append(t)
        size += len(t)
        if size >= CHUNK_CHARS:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def encode(docs: DataFrame, path: str | None = None, lexicon_words: int = 200_000, text_col: str = "text",
           ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with ``ids_col`` array<int>: the ids of ``text_col`` under the vocabulary file at ``path``. With
    ``decoded_col`` the text that the ids decode to is added by the same pass. ``lexicon_words``
    bounds the lexicon."""
    vocabulary = bpe.read_vocabulary(docs.sparkSession, path)
    name = build_lexicon(docs, vocabulary, lexicon_words, text_col)

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def code(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = bpe.load(vocabulary)
        encoder, decoder = Encoder(model, _mapped(SparkFiles.get(name))), Decoder(model)
        for column in columns:
            offsets, flat, decoded, base = [np.zeros(1, np.int64)], [], [], 0
            for chunk in _text_chunks(text_list(column)):
                off, found = encoder.encode(chunk)
                offsets.append(off[1:] + base)
                flat.append(found)
                base += len(found)
                if decoded_col:
                    decoded += [decoder.text(found[a:b]) for a, b in zip(off.tolist(), off[1:].tolist(), strict=False)]
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(offsets), pa.int32()),
                                           pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32), pa.int32()))
            yield pa.StructArray.from_arrays([ids, pa.array(decoded, pa.string()) if decoded_col else pa.nulls(len(ids), pa.string())], ["ids", "decoded"])

    coded = "__dialsift_coded"
    out = docs.withColumn(coded, code(F.col(f"`{text_col}`"))).withColumn(ids_col, F.col(f"{coded}.ids"))
    if decoded_col:
        out = out.withColumn(decoded_col, F.col(f"{coded}.decoded"))
    return out.drop(coded)


class Decoder:
    def __init__(self, model: bpe.Bpe) -> None:
        self.size = len(model.token_bytes)
        self.table = np.array([*model.token_bytes, b""], object)

    def text(self, ids: np.ndarray) -> str:
        return b"".join(self.table[ids].tolist()).decode("utf-8", "replace")


def decode(docs: DataFrame, path: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with ``out_col`` string: the text of ``ids_col``; bytes that are not UTF-8 become U+FFFD."""
    vocabulary = bpe.read_vocabulary(docs.sparkSession, path)

    @F.arrow_udf("string")
    def texts(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(bpe.load(vocabulary))
        for column in columns:
            out = []
            for k in range(len(column)):
                value = column[k].values
                if value is None or not len(value):
                    out.append("")
                    continue
                ids = value.fill_null(decoder.size).to_numpy(zero_copy_only=False)
                out.append(decoder.text(np.where((ids < 0) | (ids > decoder.size), decoder.size, ids)))
            yield pa.array(out, pa.string())

    return docs.withColumn(out_col, texts(F.col(f"`{ids_col}`")))
