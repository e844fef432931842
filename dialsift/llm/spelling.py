"""Spelling variant grouping with k-d trees over letter-count vectors.

Two words are near if one inserted, deleted or replaced character makes them equal. One replaced letter
takes one from a letter count and adds one to another, one inserted letter adds one, so the
count vectors of near words are within L1 distance two (of which at most one up and at most one down).
For each pair of lengths (L, L) and (L, L+1) the words of the longer length are the points of a k-d
tree and all words of length L are its range queries; a box whose counts differ more
from the query's than that cannot hold a near word and is pruned. What the tree returns is
verified letter by letter.

Counts are kept in unary (bit t of a letter: it occurs at least t times, up to ``LEVELS``), so a split
plane of the tree is one bit, a box is the AND and the OR of its points' bits, and distances are bit
counts. Rare letters share ``SHARED`` columns and counts above LEVELS are cut; both only
shrink distances, so no near word is lost.

The tree has two storeys. The upper planes of each length are chosen on the driver from a sample of
about ``sample`` words a length (a documented bound; every word is indexed and searched), until
a cell is expected to hold ``cell_rows`` words. A query goes to every cell within reach, which
the upper tree tells without shuffling the words first; one task grows the lower tree of
a cell in numpy and searches it with that cell's queries. Words are distinct, so there is no
hot key: cells grow in number, not in size. Where words have equal counts (anagrams), the
lower tree goes on with the counts of their first k letters, for which the same bounds hold.

Chains of forms are followed by pointer doubling: occurrences at least double
from a word to its form, so a chain has at most log2(largest n) links.

Defined cases of ``count_words``: null text has no word; a null id hashes as the empty string; each row is a
document, repeated rows count again; an empty table has no words. Of ``group_variants``: null words are left
out; repeated words are one word with the sum of their counts; ties of n are settled by
the smallest word in code-point order; extra columns are ignored, as the result is one row a word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_list

RUN = re.compile("[A-Za-zÀ-ÿ]+")
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
FLUSH = 1 << 17
LONG = 1 << 20
DEALT_AT_ONCE = 100_000

LEVELS = 4
SHARED = 6
COLUMNS = 26 + SHARED
WORDS64 = COLUMNS * LEVELS // 64
LEAF = 48
PAIRS_AT_ONCE = 1 << 20


def _noisy(word: str, crc: int, one_in: int) -> str:
    h = zlib.crc32(word.encode(), crc)
    if one_in and h % one_in == 0:
        cut = h % len(word)
        return word[:cut] + word[cut + 1 :]
    return word


def _count_batch(min_chars: int, drop_one_in: int):
    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), text_list(batch.column(1)), strict=True):
                crc = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                # a very long text is counted from a stream instead of a list of its runs
                runs = RUN.findall(text) if len(text) < LONG else (m.group() for m in RUN.finditer(text))
                for run_, n in Counter(runs).items():
                    if len(run_) >= min_chars:
                        word = _noisy(run_.translate(ASCII_LOWER), crc, drop_one_in)
                        if len(word) >= min_chars:
                            total[word] += n
                if len(total) > FLUSH:
                    yield _counted(total)
                    total = Counter()
        yield _counted(total)

    return run


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def count_words(docs: DataFrame, min_chars: int = 5, min_count: int = 3, drop_one_in: int = 0, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(word, n): runs of Latin letters of at least ``min_chars`` characters, A-Z in lower case, with at least
    ``min_count`` occurrences. With ``drop_one_in`` > 0 a run whose crc32 of `<id>:<run>` it divides loses the
    character at that crc32 modulo its length before it is counted (misspellings by rule)."""
    counted = docs.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")).mapInArrow(
        _count_batch(min_chars, drop_one_in), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# ---------------------------------------------------------------- count vectors


def letters(words: list[str], length: int) -> np.ndarray:
    """Code points, one row a word of ``length``."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def unary(chars: np.ndarray) -> np.ndarray:
    """Letter counts of each row, in unary bits packed into ``WORDS64`` numbers."""
    n = len(chars)
    column = np.where((chars >= 97) & (chars < 123), chars - 97, 26 + chars % SHARED).astype(np.int64)
    counts = np.bincount((np.arange(n)[:, None] * COLUMNS + column).ravel(), minlength=n * COLUMNS).reshape(n, COLUMNS)
    bits = counts[:, :, None] > np.arange(LEVELS)
    return np.packbits(bits.reshape(n, -1), axis=1).view(np.uint64)


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def within_reach(queries: np.ndarray, low: np.ndarray, high: np.ndarray, down: int) -> np.ndarray:
    """Can a vector in the box [low, high] be had from a query by at most one count up and ``down`` down?"""
    return (_ones(low & ~queries) <= 1) & (_ones(queries & ~high) <= down)


def _split(codes: np.ndarray) -> np.ndarray | None:
    """The most even split by one bit: True where it is set; None if all rows are equal."""
    if (codes == codes[0]).all():
        return None
    bits = np.unpackbits(codes.view(np.uint8), axis=1)
    share = np.abs(bits.mean(axis=0) - 0.5)
    return bits[:, share.argmin()] == 1


# ---------------------------------------------------------------- search in a cell


def search(points: np.ndarray, queries: np.ndarray):
    """Index pairs (query, point) of near words: ``points`` are letters of one length, ``queries`` of the
    same length or one less. Lazily, in arrays of bounded size."""
    down = int(points.shape[1] == queries.shape[1])
    stack = [(np.arange(len(points)), np.arange(len(queries)), unary(points), unary(queries), down)]
    while stack:
        p, q, pc, qc, down = stack.pop()
        codes = pc[p]
        q = q[within_reach(qc[q], np.bitwise_and.reduce(codes, axis=0), np.bitwise_or.reduce(codes, axis=0), down)]
        if not len(q):
            continue
        side = _split(codes) if len(p) > LEAF else None
        if side is None and len(p) > LEAF:  # equal counts: go on with the counts of the first letters
            pc, qc = _prefix_counts(points, queries, p, q)
            down, side = 1, _split(pc[p])
        if side is None:
            yield from _leaf(points, queries, p, q, pc, qc, down)
        else:
            stack += [(p[side], q, pc, qc, down), (p[~side], q, pc, qc, down)]


def _prefix_counts(points, queries, p, q):
    """Counts of the first k letters (zero for other rows), for the k that splits ``p`` most evenly."""
    length = points.shape[1]
    best = None
    for k in range(1, length):
        codes = unary(points[p][:, :k])
        side = _split(codes)
        if side is not None and (best is None or abs(side.mean() - 0.5) < best[0]):
            best = abs(side.mean() - 0.5), k, codes
    _, k, codes = best  # distinct words of equal counts differ in the counts of some prefix
    pc, qc = np.zeros((len(points), WORDS64), np.uint64), np.zeros((len(queries), WORDS64), np.uint64)
    pc[p], qc[q] = codes, unary(queries[q][:, :k])
    return pc, qc


def _leaf(points, queries, p, q, pc, qc, down):
    strip = max(1, PAIRS_AT_ONCE // len(p))
    for s in range(0, len(q), strip):
        part = q[s : s + strip]
        a, b = np.nonzero(within_reach(qc[part][:, None], pc[p][None], pc[p][None], down))
        a, b = part[a], p[b]
        ok = one_edit(queries[a], points[b])
        yield a[ok], b[ok]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of ``a`` that one edit turns into those of ``b`` (of equal length, or one letter longer)."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    n = a.shape[1]
    head = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= n


# ---------------------------------------------------------------- upper storey


class UpperTree:
    """Planes of one length. A node is [plane, node where its bit is set, node where it is not], a leaf [None, cell]."""

    def __init__(self, sample: np.ndarray, expected: int, cell_rows: int) -> None:
        self.cells = 0
        self.nodes = [[]]
        stack = [(0, sample, expected)]
        while stack:
            node, codes, n = stack.pop()
            plane = self._plane(codes) if n > cell_rows and len(codes) > 1 else None
            if plane is None:
                self.nodes[node] = [None, self.cells]
                self.cells += 1
                continue
            side = (codes & plane).any(axis=1)
            ones = round(n * side.mean())
            self.nodes[node] = [plane, len(self.nodes), len(self.nodes) + 1]
            stack += [(len(self.nodes), codes[side], ones), (len(self.nodes) + 1, codes[~side], n - ones)]
            self.nodes += [[], []]

    @staticmethod
    def _plane(codes: np.ndarray) -> np.ndarray | None:
        if (codes == codes[0]).all():
            return None
        share = np.abs(np.unpackbits(codes.view(np.uint8), axis=1).mean(axis=0) - 0.5)
        mask = np.zeros(WORDS64 * 64, np.uint8)
        mask[share.argmin()] = 1
        return np.packbits(mask).view(np.uint64)

    def reached(self, codes: np.ndarray, up: int, down: int):
        """(rows, cell) for each cell within at most ``up`` counts up and ``down`` down of some rows."""
        stack = [(0, np.arange(len(codes)), np.full(len(codes), up, np.int8), np.full(len(codes), down, np.int8))]
        while stack:
            node, rows, ups, downs = stack.pop()
            plane, *below = self.nodes[node]
            if plane is None:
                yield rows, below[0]
                continue
            has = (codes[rows] & plane).any(axis=1)
            for child, ups_left, downs_left in ((below[0], ups - ~has, downs), (below[1], ups, downs - has)):
                go = (ups_left >= 0) & (downs_left >= 0)
                if go.any():
                    stack.append((child, rows[go], ups_left[go], downs_left[go]))


def upper_trees(words: DataFrame, cell_rows: int, sample: int) -> dict[int, UpperTree]:
    """One tree for each length, from a hashed sample of about ``sample`` words of it."""
    sizes = {r["chars"]: r["n"] for r in words.groupBy("chars").agg(F.count("*").alias("n")).collect()}  # one row a length
    large = [k for k, n in sizes.items() if n > cell_rows]
    drawn: dict[int, list[str]] = {}
    if large:
        rates = F.create_map(*[F.lit(x) for k in large for x in (k, min(1.0, sample / sizes[k]))])
        draw = F.pmod(F.xxhash64("word"), F.lit(1 << 40)) / float(1 << 40)
        for r in words.filter(F.col("chars").isin(large) & (draw < rates[F.col("chars")])).collect():
            drawn.setdefault(r["chars"], []).append(r["word"])
    none = np.zeros((0, WORDS64), np.uint64)
    return {k: UpperTree(unary(letters(drawn[k], k)) if drawn.get(k) else none, n, cell_rows) for k, n in sizes.items()}


def _deal(trees_ref):
    """Each word as a point of its own cell, and as a query of the cells in reach among words of its length and one more."""

    def deal(batches: list[pa.RecordBatch]):
        trees = trees_ref.value
        rows = pa.Table.from_batches(batches)
        words, counts, chars = (rows[c].to_numpy() for c in ("word", "n", "chars"))
        for length in np.unique(chars).tolist():
            at = np.flatnonzero(chars == length)
            codes = unary(letters(words[at].tolist(), length))
            for points, up, down, is_query in ((length, 0, 0, False), (length, 1, 1, True), (length + 1, 1, 0, True)):
                if points in trees:
                    for found, cell in trees[points].reached(codes, up, down):
                        k = len(found)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(k, points), pa.int32()), pa.array(np.full(k, cell), pa.int32()), pa.array(np.full(k, is_query)),
                             pa.array(words[at[found]], pa.string()), pa.array(counts[at[found]], pa.int64())], ["chars", "cell", "query", "word", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:  # a walk through the tree pays for many words at once
            held.append(batch)
            size += batch.num_rows
            if size >= DEALT_AT_ONCE:
                yield from deal(held)
                held, size = [], 0
        if held:
            yield from deal(held)

    return run


def _search_cell(rows: pa.Table) -> pa.Table:
    """Both directions of each near pair between the points of a cell and its queries."""
    words, n = np.array(rows["word"].to_pylist(), object), rows["n"].to_numpy()
    query, size = rows["query"].to_numpy(), np.array([len(w) for w in words])
    length = rows["chars"][0].as_py()
    found = [(np.zeros(0, int), np.zeros(0, int))]
    p = np.flatnonzero(~query)
    points = letters(words[p].tolist(), length)
    for k in (length, length - 1):
        q = np.flatnonzero(query & (size == k))
        if len(p) and len(q):
            for a, b in search(points, letters(words[q].tolist(), k)):
                a, b = q[a], p[b]
                once = words[a] < words[b] if k == length else slice(None)  # each pair of one length is found twice
                found.append((a[once], b[once]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    return pa.table({"word": pa.array(words[a], pa.string()), "near": pa.array(words[b], pa.string()), "near_n": pa.array(n[b], pa.int64())})


def near_words(words: DataFrame, cell_rows: int = 8192, sample: int = 50_000) -> DataFrame:
    """(word, near, near_n): every ordered pair of near words of ``words`` (word, n; distinct)."""
    spark = words.sparkSession
    sized = words.select("word", F.col("n").cast("long").alias("n"), F.char_length("word").alias("chars"))
    trees_ref = spark.sparkContext.broadcast(upper_trees(sized, cell_rows, sample))
    dealt = sized.mapInArrow(_deal(trees_ref), "chars int, cell int, query boolean, word string, n long")
    return dealt.groupBy("chars", "cell").applyInArrow(_search_cell, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each row of ``forms`` (word, form), by pointer doubling; words that have arrived are
    not joined again."""
    at = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moves")), "roots")
    while at.filter("moves").limit(1).count():
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = at.filter("moves").join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moves"))
        at = materialise(jumped.unionByName(at.filter("NOT moves")), "roots")
    return at.select("word", "root")


def group_variants(words: DataFrame, ratio: int = 2, cell_rows: int = 8192, sample: int = 50_000) -> DataFrame:
    """For each word of ``words`` (word, n): form (its near word of largest n, ties to the smallest, if that n is
    at least ``ratio`` times its own), root (forms followed to the last), n, n_near, form_n."""
    words = materialise(words.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "words")
    best = near_words(words, cell_rows, sample).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    joined = words.join(best, "word", "left")
    has = -F.col("best.less") >= F.col("n") * ratio
    linked = materialise(joined.select("word", F.when(has, F.col("best.near")).alias("form"), "n",
                                       F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                       F.when(has, -F.col("best.less")).alias("form_n")), "variants")
    roots = _roots(linked.filter("form IS NOT NULL"))
    return linked.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
