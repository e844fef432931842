"""SimHash near-duplicate classes with pigeonring candidate filtering.

Fingerprint: 64 bits; a bit is 1 if it is set in over half of the XXH64 hashes
(seed 42) of the 3-word shingles of the lower-cased (A-Z) text, repeats
included. Texts link at ``max_bits`` or fewer differing bits.

Candidates. The 64 bits are m segments on a ring. By the pigeonring principle two
fingerprints within t bits have a start i such that for every length l the
segments i .. i+l-1 together differ in at most l*t/m bits. With m = 2t+1 the
first two segments of that chain must be equal: they are the join key, once
for each start. The longer chain prefixes are tested on the joined rows and
prune before the full Hamming count.

Copies share a fingerprint and are grouped first. A key with more than
``hot_bucket`` different fingerprints is not expanded into pairs: two of its
fingerprints are within 2 bits exactly if some word is at most one bit from
both, so each fingerprint meets its one-bit neighbours (outside the equal
key) and links to the smallest fingerprint it shares one with.

Defined cases: null, empty or word-less text has fingerprint zero, linked like
any other; fewer than 3 words are one shingle; repeated rows are documents of
one fingerprint; a null id never names a class (a class of null ids only has a
null id); an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, in_chunks, materialise, text_bytes
from .components import components

SEED = 42  # fixed value


def _bit_lanes() -> np.ndarray:
    """For each byte value a 64-bit word with one byte lane for each bit, the highest first."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


LANES = _bit_lanes()


def shingle_hashes(text: bytes, words_each: int = 3) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= words_each:
        return [digest(joined, SEED)]
    ends = [k - 1 for k in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-words_each])]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words_each - 1 :], strict=True)]


def fingerprints(texts: list[bytes], words_each: int = 3) -> np.ndarray:
    """Signed 64-bit fingerprints."""
    hashes, counts = [], []
    for text in texts:
        own = shingle_hashes(text, words_each)
        hashes += own
        counts.append(len(own))
    out = np.zeros(len(texts), np.uint64)
    counts = np.asarray(counts)
    used = np.flatnonzero(counts)
    if len(used):
        lanes = LANES[np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)]
        first = np.cumsum(counts) - counts
        # a byte lane holds 255 at most: sum runs of 255 hashes, then the runs of a text
        runs = -(-counts[used] // 255)
        begin = np.repeat(first[used], runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
        partial = np.add.reduceat(lanes, begin, axis=0).view(np.uint8).astype(np.int64)
        ones = np.add.reduceat(partial, np.cumsum(runs) - runs, axis=0)
        bits = np.packbits(2 * ones > counts[used][:, None], axis=1)
        out[used] = np.ascontiguousarray(bits).view(">u8").ravel()
    return out.view(np.int64)


def with_fingerprint(docs: DataFrame, out_col: str, text_col: str = "text", words_each: int = 3) -> DataFrame:
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        own = text_bytes(texts)
        parts = [fingerprints(own[a:b], words_each) for a, b in in_chunks(own)]
        return pa.array(np.concatenate(parts) if parts else [], pa.int64())

    return docs.withColumn(out_col, run(F.col(f"`{text_col}`")))


MAX_BITS = 2
SEGMENTS = 2 * MAX_BITS + 1
WIDTHS = [64 // SEGMENTS + (k < 64 % SEGMENTS) for k in range(SEGMENTS)]
OFFSETS = [sum(WIDTHS[:k]) for k in range(SEGMENTS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(start: int, length: int) -> int:
    """Bits of ``length`` consecutive segments on the ring from ``start``."""
    return sum(((1 << WIDTHS[k % SEGMENTS]) - 1) << OFFSETS[k % SEGMENTS] for k in range(start, start + length))


def _in_chain(x, start):
    """Whether the differing bits ``x`` keep every proportional budget from ``start`` on;
    the last prefix of the chain is the full Hamming check."""
    def chain(i):
        tests = [F.bit_count(x.bitwiseAND(F.lit(_signed(_mask(i, n))))) <= n * MAX_BITS // SEGMENTS for n in range(3, SEGMENTS + 1)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    case = F.when(start == 0, chain(0))
    for i in range(1, SEGMENTS):
        case = case.when(start == i, chain(i))
    return case


def links(prints: DataFrame, hot_bucket: int = 64) -> DataFrame:
    """(a, b): edges between the distinct fingerprints in column ``fp`` whose closure is that
    of all pairs within ``MAX_BITS`` bits."""
    keys = F.array(*(F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(i, 2)))).alias("key")) for i in range(SEGMENTS)))
    ring = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.start", "k.key")
    shared = ring.groupBy("start", "key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = materialise(hot_join(ring, shared, ["start", "key"], prints.count() * SEGMENTS), "simhash-buckets")

    cold = buckets.filter(F.col("n") <= hot_bucket)
    a, b = cold.select("start", "key", F.col("fp").alias("a")), cold.select("start", "key", F.col("fp").alias("b"))
    pairs = a.join(b, ["start", "key"]).filter(F.col("a") < F.col("b"))
    pairs = pairs.filter(_in_chain(F.col("a").bitwiseXOR(F.col("b")), F.col("start"))).select("a", "b")

    flips = F.lit(None).cast("array<long>")
    for i in range(SEGMENTS):
        free = [_signed(1 << k) for k in range(64) if not _mask(i, 2) >> k & 1]
        flips = F.when(F.col("start") == i, F.array(*(F.lit(f) for f in [0, *free]))).otherwise(flips)
    near = (buckets.filter(F.col("n") > hot_bucket).select("start", "key", "fp", F.explode(flips).alias("flip"))
            .select("start", "key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word")))
    least = near.groupBy("start", "key", "word").agg(F.min("fp").alias("a"))
    hot = near.join(least, ["start", "key", "word"]).filter(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))
    return pairs.unionByName(hot).distinct()


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, hot_bucket: int = 64) -> DataFrame:
    """(<id_col>, fp, component_id) for every row of ``docs``: the signed fingerprint and the
    smallest id reachable over links of at most ``MAX_BITS`` bits."""
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = materialise(with_fingerprint(text, "fp", "text", words_each).select("id", "fp"), "simhash")
    groups = materialise(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "simhash-groups")
    joined = materialise(components(links(groups.select("fp"), hot_bucket)), "simhash-components")
    linked = groups.join(joined.withColumnRenamed("node", "fp"), "fp")
    roots = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    # fingerprints of one document without links are a class of their own and need no join
    several = groups.join(joined.select(F.col("node").alias("fp")), "fp", "left_anti").filter("n > 1").select("fp", F.col("low").alias("component_id"), "n")
    labels = linked.select("fp", "root", "n").join(roots, "root").select("fp", "component_id", "n").unionByName(several)
    labels = materialise(labels.withColumn("found", F.lit(True)), "simhash-labels")
    # copies of a text may hold a third of the rows
    out = hot_join(rows, labels, ["fp"], rows.count(), "left")
    return out.select(F.col("id").alias(id_col), "fp", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
