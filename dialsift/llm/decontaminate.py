"""Benchmark decontamination by greedy string tiling.

Documents and test items become lower-cased word tokens without ASCII
punctuation. Seeds of ``min_match`` consecutive tokens shared by a document
and an item make a candidate pair; an item with fewer tokens is its own seed. For a pair,
greedy tiling marks the longest non-overlapping match of unmarked tokens again and again, down
to ``min_match``; running Karp-Rabin hashes of all windows tell the longest length. The share of the
item's tokens under tiles is its coverage, whatever the order in which its passages occur.

The test set is the query set: it is taken in blocks of bounded size, each
broadcast to a scan of the documents and released after it, so no document is shuffled, one block is
held at a time, and a passage that occurs in very many documents costs each of them only its own tiling.

Defined cases: null or empty texts have no tokens and match nothing; an item of fewer
than ``min_match`` tokens is found where all of them stand in a row; repeated items are
items of their own; without items or documents nothing is found.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Joined, grams, in_chunks, materialise, mix, numbered, text_list

MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
BLANKED = bytes.maketrans(MARKS, b" " * len(MARKS))
LEAK = "struct<item_id: long, coverage: double, matched: int, tiles: int, longest: int>"


def tokens_text(text: str) -> bytes:
    """Tokens of a text, separated by white space."""
    return text.lower().encode().translate(BLANKED)


class Hashed:
    """Karp-Rabin hashes of every window of a token sequence, from running sums modulo 2^64."""

    _rng = np.random.Generator(np.random.PCG64(20250611))
    RANDOM = _rng.integers(1, 1 << 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        power = np.full(n + 1, Joined.BASE, np.uint64)
        back = np.full(n + 1, Joined.INVERSE, np.uint64)
        power[0] = back[0] = 1
        value = mix(codes.astype(np.uint64) + self.RANDOM[codes % len(self.RANDOM)])
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * np.cumprod(power)[:-1], dtype=np.uint64)))
        self.back = np.cumprod(back)
        self.blocked = codes == 0  # matches no token; marked tokens join them
        self.block_all()

    def block_all(self) -> None:
        self.before = np.concatenate(([0], np.cumsum(self.blocked)))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows of ``size`` free tokens."""
        at = np.flatnonzero(self.before[size:] == self.before[:-size]) if size < len(self.before) else np.empty(0, np.int64)
        return at, (self.sums[at + size] - self.sums[at]) * self.back[at]


def tile(doc: list[int], item: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (start in doc, start in item, length) of two token sequences: always the longest match
    of free tokens, ties by place in the document, then in the item; token 0 matches nothing.

    A common window of some length implies one of every shorter length, so the longest length is
    found by bisection, with the hashes of all windows of a length at once. Windows of the longest length
    are marked in one pass over both sequences, however many pairs of them are equal."""
    codes, words = np.asarray(doc, np.int64), np.asarray(item, np.int64)
    a, b = Hashed(codes), Hashed(words)
    tiles, most = [], min(len(doc), len(item))
    while most >= min_match:
        low, high = min_match - 1, most  # a common window of length low exists, or low is below the least
        while low < high:
            size = (low + high + 1) // 2
            if np.isin(a.windows(size)[1], b.windows(size)[1]).any():
                low = size
            else:
                high = size - 1
        if low < min_match:
            break
        tiles += _mark(a, b, codes, words, low)
        most = low - 1  # no two free windows of this length are equal any more
    return tiles


def _mark(a: Hashed, b: Hashed, doc: np.ndarray, item: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Take the equal free windows of ``size``, in order, as long as both stay free."""
    (at, hashes), (item_at, item_hashes) = a.windows(size), b.windows(size)
    hit = np.isin(hashes, item_hashes)
    waiting: dict[int, deque] = defaultdict(deque)
    for j, h in zip(item_at.tolist(), item_hashes.tolist(), strict=True):
        waiting[h].append(j)
    tiles, end = [], -1
    for i, h in zip(at[hit].tolist(), hashes[hit].tolist(), strict=True):
        places = waiting[h]
        while places and b.blocked[places[0]:places[0] + size].any():
            places.popleft()  # marked tokens stay marked
        if i >= end and places and (doc[i:i + size] == item[places[0]:places[0] + size]).all():
            j = places.popleft()
            a.blocked[i:i + size] = b.blocked[j:j + size] = True
            tiles.append((i, j, size))
            end = i + size
    a.block_all()
    b.block_all()
    return tiles


class Items:
    """One block of the test set with its seeds, by their number of tokens."""

    def __init__(self, rows: list[tuple[int, str]], min_match: int) -> None:
        self.ids = [i for i, _ in rows]
        texts = [tokens_text(t or "") for _, t in rows]
        self.tokens = [t.split() for t in texts]
        self.least = [min(min_match, len(t)) for t in self.tokens]
        least = np.array(self.least, np.int64)
        joined = Joined(texts)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # size: hashes, owners, bounds of the owners
        for size in sorted(set(self.least) - {0}):
            _, hashes, owner = _seeds(joined, size)
            own = least[owner] == size
            hashes, owner = hashes[own], owner[own]
            order = np.argsort(hashes, kind="stable")
            found, first = np.unique(hashes[order], return_index=True)
            self.seeds[size] = found, owner[order], np.append(first, len(order))

    def leaks(self, words: list[bytes], at: np.ndarray, slot: np.ndarray, size: np.ndarray, threshold: float) -> list[tuple]:
        """Items that the tiles cover to the threshold, from the seeds found at token positions ``at``."""
        places = defaultdict(set)
        for k, s, n in zip(at.tolist(), slot.tolist(), size.tolist(), strict=True):
            _, owner, bounds = self.seeds[n]
            for item in owner[bounds[s] : bounds[s + 1]].tolist():
                places[item].add(k)
        out = []
        for item, found in sorted(places.items()):
            own, least = self.tokens[item], self.least[item]
            code = {t: n + 1 for n, t in enumerate(dict.fromkeys(own))}
            # every match lies inside runs of seeds; a 0 between runs matches no token
            spans, last = [], -1
            for k in sorted(found):
                if k > last and spans:
                    spans.append(0)
                spans += [code.get(w, 0) for w in words[max(k, last) : k + least]]
                last = k + least
            tiles = tile(spans, [code[t] for t in own], least)
            matched = sum(n for _, _, n in tiles)
            if tiles and matched >= threshold * len(own):
                out.append((self.ids[item], matched / len(own), matched, len(tiles), max(n for _, _, n in tiles)))
        return out


def _seeds(texts: Joined, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the first token, seed hash, text index)."""
    starts, ends, owner = texts.words()
    hashes = grams(texts.hashes(starts, ends), size)
    inside = np.flatnonzero(owner[: len(hashes)] == owner[size - 1 :]) if len(hashes) else np.empty(0, np.int64)
    return inside, hashes[inside], owner[inside]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The test set in parts of about ``block_bytes`` of text."""
    rows = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    return [rows if n == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) for k in range(n)]


def _rows(block: DataFrame) -> list[tuple[int, str]]:
    return [(r["id"], r["text"]) for r in block.collect()]  # of about block_bytes


ROW = "__leak_row"


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out_col: str = "leaks", item_id: str = "item_id",
               item_text: str = "text", min_match: int = 5, threshold: float = 0.6, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with ``out_col``: the items (id, coverage, matched tokens, tiles, longest tile) of
    which at least ``threshold`` of the tokens are tiled by the document.

    A test set of one block is searched when the result is. A larger one takes a scan of the documents for
    each block; what it finds is written to the shared folder and the block is released."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    blocks = _blocks(benchmark, id_col=item_id, text_col=item_text, block_bytes=block_bytes)
    if len(blocks) == 1:
        return docs.withColumn(out_col, _search(spark.sparkContext.broadcast(_rows(blocks[0])), min_match, threshold)(text))
    rows, parts = numbered(docs, ROW), []
    for block in blocks:
        ref = spark.sparkContext.broadcast(_rows(block))
        found = rows.select(ROW, _search(ref, min_match, threshold)(text).alias("found"))
        parts.append(materialise(found.filter(F.size("found") > 0), "leaks"))
        ref.destroy()
    found = reduce(DataFrame.unionByName, parts).groupBy(ROW).agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("__found"))
    none = F.array().cast(f"array<{LEAK}>")
    return rows.join(found, ROW, "left").withColumn(out_col, F.coalesce("__found", none)).select(
        *(F.col(f"`{c}`") for c in docs.columns if c != out_col), F.col(f"`{out_col}`"))


def _search(ref, min_match: int, threshold: float):
    def search(items: Items, texts: list[str]) -> list[list[tuple]]:
        out: list[list[tuple]] = [[] for _ in texts]
        joined = [tokens_text(t) for t in texts]
        for a, b in in_chunks(joined):
            chunk, hits = Joined(joined[a:b]), []
            for size, (known, _, _) in items.seeds.items():
                first, seeds, owner = _seeds(chunk, size)
                slot = np.minimum(np.searchsorted(known, seeds), len(known) - 1)
                hit = np.flatnonzero(known[slot] == seeds)
                hits.append((owner[hit], first[hit], slot[hit], np.full(len(hit), size)))
            if not any(len(h[0]) for h in hits):
                continue
            owner, first, slot, size = (np.concatenate(x) for x in zip(*hits, strict=True))
            order = np.argsort(owner, kind="stable")
            begin = np.searchsorted(chunk.words()[2], np.arange(b - a))  # first token of each text
            docs, at = np.unique(owner[order], return_index=True)
            for doc, own in zip(docs.tolist(), np.split(order, at[1:]), strict=True):
                out[a + doc] = items.leaks(joined[a + doc].split(), first[own] - begin[doc], slot[own], size[own], threshold)
        return out

    @F.arrow_udf(f"array<{LEAK}>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = Items(ref.value, min_match)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("matched", pa.int32()), ("tiles", pa.int32()), ("longest", pa.int32())]))
        names = ["item_id", "coverage", "matched", "tiles", "longest"]
        for column in columns:
            yield pa.array([[dict(zip(names, leak, strict=True)) for leak in leaks] for leaks in search(items, text_list(column))], kind)

    return run
