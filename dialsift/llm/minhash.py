"""Document fingerprints by MinHash over word shingles.

A fingerprint is the minimum of each of ``PERMUTATIONS`` universal hash
permutations x -> a*x + b mod 2^64 (a odd) over the hashes of the text's
5-word shingles, computed in vectorised numpy and kept to its upper 32 bits.
The share of equal components estimates the Jaccard similarity.

``neighbours_in_order`` gives each row the following row of a global order
with one shuffle: rows are dealt to slices of the key by bounds from a
quantile sketch, and the first row of each slice is sent to the slice before as well.

``near_duplicates`` joins bands of the fingerprints in Spark and verifies
the Jaccard similarity of each candidate pair on the shingles themselves. Two Bloom filters tell which bands occur
twice; only those are shuffled. The texts of candidates alone are shuffled for their shingles, told by a
bitmap of bounded size. Equal texts are one representative.

Defined cases: words are runs of bytes other than white space, A-Z
lower-cased; fewer than 5 words are one shingle; a null, empty or word-less text has the
fingerprint of the empty set (all components at their maximum), alike only to itself;
null ids come last in descending order; rows of one id are ordered by text; a single row
is its own next row; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Joined, grams, in_chunks, materialise, mix, text_list
from .components import components
from .line_dedup import PROBES, Suspects, _parts, twice_seen

PERMUTATIONS = 128
SHINGLE_WORDS = 5
BANDS, BAND_ROWS = 25, 5  # finds pairs of similarity 0.8 with probability 0.9999
_draw = np.random.Generator(np.random.PCG64(5))
A = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
B = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
EMPTY = np.iinfo(np.uint32).max
BITMAP_BITS = 1 << 25
FEW = 256  # texts of a block of a bucket, at least
SKETCH_BITS = 4  # bits of a sketch for each shingle, at least
CACHE_BYTES = 192 << 10  # a chunk whose shingle hashes stay in the processor's cache


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of the shingles of the texts, in order of the texts."""
    joined = Joined([t.lower() for t in texts])
    starts, ends, text = joined.words()
    words = joined.hashes(starts, ends)
    runs = grams(words, SHINGLE_WORDS)
    whole = text[: len(runs)] == text[SHINGLE_WORDS - 1 :] if len(runs) else np.empty(0, bool)
    hashes, owner = runs[whole], text[: len(runs)][whole]
    counts = np.bincount(text, minlength=len(texts))
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE_WORDS))
    if len(few):
        first = np.searchsorted(text, few)
        short = np.array([mix(np.array([hash_words(words[f : f + counts[k]])], np.uint64))[0] for f, k in zip(first, few, strict=True)], np.uint64)
        hashes, owner = np.concatenate([hashes, short]), np.concatenate([owner, few])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def hash_words(words: np.ndarray) -> int:
    out = len(words)
    for w in words.tolist():
        out = (out * 0xD6E8FEB86659FD93 + w) & 0xFFFFFFFFFFFFFFFF
    return out


def signatures(texts: list[bytes]) -> np.ndarray:
    """One row of PERMUTATIONS 32-bit minima for each text."""
    out = np.full((len(texts), PERMUTATIONS), EMPTY, np.uint32)
    for a, b in in_chunks(texts, CACHE_BYTES):
        hashes, owner = shingles(texts[a:b])
        if not len(hashes):
            continue
        rows, first = np.unique(owner, return_index=True)
        work = np.empty_like(hashes)
        for k in range(PERMUTATIONS):
            np.multiply(hashes, A[k], out=work)
            np.add(work, B[k], out=work)
            out[a + rows, k] = np.minimum.reduceat(work, first) >> np.uint64(32)
    return out


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _slices(spark, bounds: list[int]):
    """Slice of each id: ids above the highest bound are slice 0; null ids follow the lowest ones."""
    ref = spark.sparkContext.broadcast(np.array(bounds, np.int64))  # one number a slice

    @F.arrow_udf("int")
    def slice_of(ids: pa.Array) -> pa.Array:
        bounds = ref.value
        known = ids.fill_null(0).to_numpy(zero_copy_only=False)
        at = len(bounds) - np.searchsorted(bounds, known)
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), len(bounds), at), pa.int32())

    return slice_of


def neighbours_in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_slice: int = 50_000,
                        notes: DataFrame | None = None) -> DataFrame:
    """(id, text, digest, class_id, borrowed) in partitions sorted by descending id: each partition ends with
    the row that follows its last own row, marked ``borrowed`` (the very first row after the very last).
    ``notes`` (id, digest, class_id) come without a text, before the rows of their id."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ids = rows.select("id")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ids.count() // rows_per_slice))
    bounds = sorted({int(b) for b in ids.approxQuantile("id", [k / n for k in range(1, n)], 1 / (4 * n))}) if n > 1 else []
    slice_of = _slices(spark, bounds)
    heads = ids.select("id", slice_of("id").alias("slice")).groupBy("slice").agg(F.max("id").alias("id")).orderBy("slice").collect()
    before = {h["slice"]: heads[k - 1]["slice"] for k, h in enumerate(heads)}
    lent = spark.createDataFrame([(h["id"], before[h["slice"]]) for h in heads], "head long, lent_to int")  # one row for each slice
    dealt = rows.withColumn("digest", F.xxhash64("text")).withColumn("slice", slice_of("id")).join(F.broadcast(lent), F.col("id").eqNullSafe(F.col("head")), "left")
    targets = F.array(F.struct(F.col("slice").alias("to"), F.lit(False).alias("borrowed")), F.struct(F.col("lent_to").alias("to"), F.lit(True).alias("borrowed")))
    dealt = dealt.select("id", "text", "digest", F.lit(None).cast("long").alias("class_id"), F.explode(targets).alias("t")).filter("t.to IS NOT NULL")
    dealt = dealt.select("id", "text", "digest", "class_id", "t.to", "t.borrowed")
    if notes is not None:
        dealt = dealt.unionByName(notes.select("id", F.lit(None).cast("string").alias("text"), "digest", "class_id", slice_of("id").alias("to"), F.lit(False).alias("borrowed")))
    placed = dealt.repartitionById(max(1, len(bounds) + 1), "to")
    return placed.sortWithinPartitions("borrowed", F.col("id").desc_nulls_last(), "text").select("id", "text", "digest", "class_id", "borrowed")


FINGERPRINTS = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                "near_edited double, near_next double, class_id long")


def _fingerprint_batch(ids: list, texts: list[str], classes: list) -> pa.RecordBatch:
    """Rows for all but the last text, which only follows."""
    changed = [edited(t, u) for t, u in zip(texts, texts[1:], strict=False)]
    own, other = signatures([t.encode() for t in texts]), signatures([t.encode() for t in changed])
    hexed = lambda s: [row.astype(">u4").tobytes().hex() for row in s]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
         pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(hexed(own[:-1])), pa.array(hexed(other)),
         pa.array((own[:-1] == other).mean(axis=1)), pa.array((own[:-1] == own[1:]).mean(axis=1)), pa.array(classes[:-1], pa.int64())],
        ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id"])


def _fingerprint_stream(batches):
    ids, texts, classes, size, done = [], [], [], 0, False
    noted, of = {}, None  # classes by digest of the rows of id ``of``
    for batch in batches:
        for i, text, digest, class_id, borrowed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if done:
                continue  # more rows of the borrowed id: the first one follows
            if text is None:
                noted = noted if i == of else {}
                of, noted[digest] = i, class_id
                continue
            ids.append(i)
            texts.append(text)
            classes.append(noted.get(digest, i) if i == of else i)
            size += len(text)
            done = borrowed
            if size > 1 << 20 and len(ids) > 1:
                yield _fingerprint_batch(ids, texts, classes)
                ids, texts, classes, size = ids[-1:], texts[-1:], classes[-1:], len(texts[-1])
    if len(ids) > 1:
        yield _fingerprint_batch(ids, texts, classes)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_classes: bool = False,
                          threshold: float = 0.8) -> DataFrame:
    """For every row: its fingerprint, that of its text edited with the next row's beginning
    (descending id), the likeness of its fingerprint to both, and ``with_classes`` its class of verified near copies."""
    notes = near_classes(docs, threshold, id_col, text_col) if with_classes else None
    rows = neighbours_in_order(docs, id_col, text_col, notes=notes).mapInArrow(_fingerprint_stream, FINGERPRINTS).withColumnRenamed("id", id_col)
    return rows if with_classes else rows.drop("class_id")


def _bands(texts: list[bytes]) -> np.ndarray:
    """One hash for each band of the signatures."""
    sig = signatures(texts).astype(np.uint64)
    out = np.zeros((len(texts), BANDS), np.uint64)
    for k in range(BAND_ROWS):
        out = out * np.uint64(0xD6E8FEB86659FD93) + sig[:, k : BANDS * BAND_ROWS : BAND_ROWS]
    return mix(out).view(np.int64)


def _key_bits(keys: np.ndarray, mask: int) -> np.ndarray:
    """Bit positions of band keys, one row a key."""
    h = keys.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(mask)


def _band_keys(batch_texts: list[str]) -> Iterator[np.ndarray]:
    """The band keys of each text; the band's number is part of them."""
    texts = [t.encode() for t in batch_texts]
    for a, b in in_chunks(texts):
        yield from mix(_bands(texts[a:b]).view(np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _build_keys(bits: int):
    """Once- and twice-seen filters of a task's band keys; a text that repeats one lately seen adds nothing."""

    def run(batches):
        once, twice, seen = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8), set()
        for batch in batches:
            texts = dict.fromkeys(t for t in text_list(batch.column(0)) if hash(t) not in seen)
            seen = {hash(t) for t in texts} | (seen if len(seen) < 100_000 else set())
            for keys in _band_keys(list(texts)):
                pos = _key_bits(keys, bits - 1)
                at, bit = (pos >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (pos & np.uint64(7)).astype(np.uint8))
                known = ((once[at] & bit) != 0).all(axis=1)
                np.bitwise_or.at(twice, at[known].ravel(), bit[known].ravel())
                np.bitwise_or.at(once, at[~known].ravel(), bit[~known].ravel())
        yield from _parts(once, twice)

    return run


def _suspect_keys(filter_ref):
    """(key, rep) of the band keys that occur in two texts."""

    def run(batches):
        suspects = Suspects(*filter_ref.value)
        for batch in batches:
            reps = batch.column(0).to_numpy(zero_copy_only=False)
            found, owner = [], []
            for rep, keys in zip(reps.tolist(), _band_keys(text_list(batch.column(1))), strict=True):
                hit = keys[suspects.at(_key_bits(keys, suspects.mask))]
                found.append(hit)
                owner.append(np.full(len(hit), rep))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64()), pa.array(np.concatenate(owner), pa.int64())], ["key", "rep"])

    return run


def _sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingles of each row of a column of texts or of shingles."""
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        return [np.unique(np.asarray(x, np.int64)) for x in column.to_pylist()]
    texts, out = [t.encode() for t in text_list(column)], []
    for a, b in in_chunks(texts):
        hashes, owner = shingles(texts[a:b])
        cuts = np.searchsorted(owner, np.arange(b - a + 1))
        out += [np.unique(hashes[lo:hi].view(np.int64)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return out


def jaccard_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted distinct values; two empty sets are equal."""
    if not len(a) or not len(b):
        return 0.0 if len(a) == len(b) else 1.0
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 1 - both / (len(a) + len(b) - both)


@F.arrow_udf(T.DoubleType())
def set_distances(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for of_a, of_b in columns:
        coded = of_a.dictionary_encode() if pa.types.is_string(of_a.type) else None  # a text is met by many
        first = _sets(of_a) if coded is None else [s for k in [_sets(coded.dictionary)] for s in (k[i] for i in coded.indices.to_pylist())]
        yield pa.array([jaccard_distance(a, b) for a, b in zip(first, _sets(of_b), strict=True)], pa.float64())


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``far``: the Jaccard distance of their shingle sets, which ``sets`` (rep, and the texts or
    the shingles) has. Only rows of the pairs are shuffled; a text is about half as many bytes as its shingles."""
    content = next(c for c in sets.columns if c != "rep")
    side = lambda c: _among(sets, pairs.select(F.col(c).alias("rep"))).select(F.col("rep").alias(c), F.col(content).alias(f"of_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", set_distances("of_a", "of_b").alias("far"))


def _among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` whose ``rep`` may be among ``wanted``, by a bitmap of BITMAP_BITS bits (a bounded broadcast)."""
    bit = lambda rep: F.pmod(rep, F.lit(BITMAP_BITS)) + 1
    bitmap = wanted.groupBy(F.bitmap_bucket_number(bit(F.col("rep"))).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit(F.col("rep")))).alias("bits"))
    met = rows.withColumn("bucket", F.bitmap_bucket_number(bit(F.col("rep")))).join(F.broadcast(bitmap), "bucket")
    place = F.bitmap_bit_position(bit(F.col("rep"))).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.filter(F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1).drop("bucket", "bits")


def sketch(values: np.ndarray) -> bytes:
    """One parity bit for each cell of a hash table of at least SKETCH_BITS cells a shingle. The bits in which two
    sketches differ are at most as many as the shingles that only one text has. The halves of a
    sketch folded together are the sketch of half as many cells."""
    cells = max(256, 1 << (SKETCH_BITS * len(values) - 1).bit_length()) if len(values) else 256
    at = (mix(values.view(np.uint64)) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=cells) & 1).astype(np.uint8), bitorder="little").tobytes()


def _sketches(batches):
    for batch in batches:
        sets = _sets(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch(s) for s in sets], pa.binary())], ["rep", "n", "bits"])


def most_apart(threshold: float) -> float:
    """Two sets of Jaccard similarity ``threshold`` or more differ in at most this share of their summed sizes."""
    least = threshold - 1e-6
    return (1 - least) / (1 + least)


def near_by_sketch(n: np.ndarray, bits: list[bytes], apart: float, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, share of differing bits) of the places whose sketches let them be near; ``wanted(u, others)`` tells which
    others u is to be compared with. Exact one way: no near pair is left out. Sizes of near texts
    differ by a quarter at most, so sketches of more than twice the length are not compared."""
    size = np.array([len(b) for b in bits])
    us, vs, ws = [], [], []
    for length in np.unique(size):
        own, twice = np.flatnonzero(size == length), np.flatnonzero(size == 2 * length)
        rows = np.frombuffer(b"".join([bits[k] for k in own]), np.uint64).reshape(len(own), -1)
        if len(twice):
            halves = np.frombuffer(b"".join([bits[k] for k in twice]), np.uint64).reshape(len(twice), 2, -1)
            rows = np.concatenate([rows, halves[:, 0] ^ halves[:, 1]])
        places = np.concatenate([own, twice])
        for r, u in enumerate(own):
            others = places[r + 1 :]
            pick = np.flatnonzero(wanted(u, others))
            if not len(pick):
                continue
            others = others[pick]
            differ = np.bitwise_count(rows[r + 1 + pick] ^ rows[r]).sum(axis=1, dtype=np.int64)
            both = n[u] + n[others]
            near = differ <= both * apart + 1e-6
            us.append(np.full(int(near.sum()), u))
            vs.append(others[near])
            ws.append(differ[near] / np.maximum(both[near], 1))
    if not us:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return np.concatenate(us), np.concatenate(vs), np.concatenate(ws)


def forest(u: np.ndarray, v: np.ndarray, weight: np.ndarray, classes: np.ndarray) -> list[int]:
    """Places of the lightest edges that connect all classes that the edges connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root.setdefault(root[x], root[x])
        return x

    kept, left = [], len(np.unique(np.concatenate([classes[u], classes[v]]))) - 1
    ends = list(zip(classes[u].tolist(), classes[v].tolist(), strict=True))
    for k in np.argsort(weight, kind="stable").tolist():
        a, b = (find(x) for x in ends[k])
        if a != b:
            root[a] = b
            kept.append(k)
            if len(kept) == left:
                break
    return kept


def _bucket_pairs(apart: float, spanning: bool):
    """(a, b) of the rows (key, lo, hi, block, class, rep, n, bits), sorted by the first three: pairs of block ``lo`` with block
    ``hi`` of a bucket that are of two classes and may be near; with ``spanning`` a forest of them."""

    def pairs_of(blocks, classes, reps, n, bits):
        other = len(np.unique(blocks)) > 1
        u, v, w = near_by_sketch(n, bits, apart, lambda u, o: (classes[o] != classes[u]) & ((blocks[o] != blocks[u]) | (not other)))
        if spanning and len(u) > 1:
            kept = forest(u, v, w, classes)
            u, v = u[kept], v[kept]
        return np.minimum(reps[u], reps[v]), np.maximum(reps[u], reps[v])

    def run(batches):
        left, left_bits = None, []

        def groups(rows, bits, last):
            changed = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
            cuts = [0, *changed.tolist(), *([rows.shape[1]] if last else [])]
            found = [pairs_of(*rows[3:7, a:b], bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)
                     if b - a > 1 and (rows[1, a] == rows[2, a] or (rows[3, a:b] != rows[3, a]).any())]
            a = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
            b = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)
            return cuts[-1], pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:7]])
            rows, bits = rows if left is None else np.concatenate([left, rows], axis=1), left_bits + batch.column(7).to_pylist()
            done, out = groups(rows, bits, False)
            left, left_bits = rows[:, done:], bits[done:]
            yield out
        if left is not None and left.shape[1]:
            yield groups(left, left_bits, True)[1]

    return run


def _candidates(state: DataFrame, sketches: DataFrame, apart: float, spanning: bool) -> DataFrame:
    """(a, b) of the buckets (key, rep, class) that are of two classes and may be near by their sketches. A bucket of over
    FEW texts is cut into blocks that meet in pairs, so no task holds it whole."""
    sizes = state.groupBy("key").agg(F.count("*").alias("n_rows"), F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi")
    most = F.greatest(F.lit(max(FEW, 2)), F.least(F.ceil(F.col("n_rows") / 16), F.lit(2048)))
    rows = state.join(sizes.select("key", F.ceil(F.col("n_rows") / most).cast("int").alias("blocks")), "key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).join(sketches, "rep")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "class", "rep", "n", "bits")
    dealt = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "rep")
    return dealt.mapInArrow(_bucket_pairs(apart, spanning), "a long, b long").distinct()


def _sifted(pairs: DataFrame, sketches: DataFrame, apart: float) -> DataFrame:
    """``pairs`` (a, b) that may be near by their sketches."""

    @F.arrow_udf(T.BooleanType())
    def may(n_a: pa.Array, bits_a: pa.Array, n_b: pa.Array, bits_b: pa.Array) -> pa.Array:
        n = np.stack([n_a.to_numpy(), n_b.to_numpy()], axis=1).astype(np.int64)
        both = lambda u, o: np.ones(len(o), bool)
        return pa.array([len(near_by_sketch(m, [x, y], apart, both)[0]) > 0 for m, x, y in zip(n, bits_a.to_pylist(), bits_b.to_pylist(), strict=True)], pa.bool_())

    side = lambda c: sketches.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(may("n_a", "bits_a", "n_b", "bits_b")).select("a", "b")


def _links(buckets: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): verified links of the buckets (key, rep) that connect all texts that the links of all pairs of a bucket connect.

    First each text is verified once, against the smallest text that it shares any band with. Buckets
    whose texts are of one class by these links are done: near copies share most of their bands. In the others pairs of two
    classes meet by their sketches, which leave out only pairs that cannot be near. A forest of
    what is left is verified, and last all that is still of two classes. Three steps for buckets of any size; only
    sketches meet in pairs."""
    limit, apart = 1 - threshold + 1e-9, most_apart(threshold)
    sketches = materialise(sets.mapInArrow(_sketches, "rep long, n int, bits binary"), "band-sketches")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        return materialise(_distances(materialise(pairs, f"{name}-pairs"), sets), name)

    near = lambda known: known.filter(F.col("far") <= limit).select("a", "b")

    def classed(links: DataFrame) -> DataFrame:
        return materialise(buckets.join(components(links).withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("class")), "band-classed")

    low = buckets.groupBy("key").agg(F.min("rep").alias("low"))
    nearest = buckets.join(low, "key").groupBy("rep").agg(F.min("low").alias("a")).filter("a <> rep").select("a", F.col("rep").alias("b"))
    found = verified(_sifted(nearest, sketches, apart), "band-first")
    found = found.unionByName(verified(_candidates(classed(near(found)), sketches, apart, True), "band-forest"))
    rest = _candidates(classed(near(found)), sketches, apart, False).join(found.select("a", "b"), ["a", "b"], "left_anti")
    return near(found.unionByName(verified(rest, "band-rest")))


def near_classes(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 28) -> DataFrame:
    """(id, digest, class_id) of every row that is in a class with another: class_id is the smallest id reachable over
    links between texts of at least ``threshold`` Jaccard similarity that share a band; null ids never name a
    class. ``digest`` is the text's. Written to the shared folder."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("rep", F.xxhash64("text"))
    filter_ref = docs.sparkSession.sparkContext.broadcast(twice_seen(rows.select("text"), max_bits, _build_keys))
    members = rows.select("rep", "text").mapInArrow(_suspect_keys(filter_ref), "key long, rep long").distinct()
    members = materialise(members, "band-members")
    shared = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    buckets = materialise(members.join(shared, "key"), "band-buckets")
    wanted = materialise(buckets.select("rep").distinct(), "band-texts")
    texts = _among(rows.select("rep", "text"), wanted).join(wanted, "rep", "left_semi").groupBy("rep").agg(F.first("text").alias("text"))
    sets = materialise(texts, "band-sets")
    root = components(_links(buckets, sets, threshold)).withColumnRenamed("node", "rep")
    # texts first, rows last: copies of a text that hold a third of the rows are one text
    of_text = materialise(rows.groupBy("rep").agg(F.min("id").alias("low"), F.count("*").alias("n")), "band-digests")
    of_text = of_text.join(root, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    classes = of_text.groupBy("root").agg(F.min("low").alias("class_id"), F.sum("n").alias("rows")).filter("rows > 1").select("root", "class_id")
    named = materialise(of_text.join(classes, "root").select("rep", "class_id"), "near-classes")
    return materialise(rows.select("id", "rep").join(named, "rep").select("id", F.col("rep").alias("digest"), "class_id").distinct(), "near-rows")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id_col>, class_id) for every row; a row of no class is its own (see ``near_classes``)."""
    named = near_classes(docs, threshold, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("digest"))
    met = rows.join(named.withColumnsRenamed({"id": "named", "digest": "of"}), (F.col("digest") == F.col("of")) & F.col("id").eqNullSafe(F.col("named")), "left")
    return met.select(F.col("id").alias(id_col), F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))
