"""Line deduplication with two Bloom filters.

Pass 1 builds, per task, one filter of line keys seen in a document and one of
keys seen in a second document; the partial filters are merged in a tree
(a key once in each of two parts is twice-seen). Only keys that the
twice-seen filter holds can repeat: pass 2 shuffles just these, pre-aggregated
per task, and confirms them by exact string and document count. Pass 3 drops
the confirmed lines, all of them or all but the first occurrence.

The filters have a fixed upper size; a fuller filter lets more keys through to
the exact confirmation and never changes a result.

Defined cases: null or empty text is one empty line; a key is the line without
white space (0x20, 0x09-0x0D) at both ends and with A-Z lower-cased; empty keys
are never dropped; a key repeated inside one document counts once; each input
row is a document; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, materialise, text_bytes

PROBES = 3
PART_BYTES = 1 << 18  # a filter travels in parts of this size


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def _bit_positions(keys, mask: int) -> np.ndarray:
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    probes = np.arange(PROBES, dtype=np.uint64)
    return (h[:, None] + step[:, None] * probes) & np.uint64(mask)


def _filter_bits(n_rows: int, max_bits: int) -> int:
    """Power of two near 256 bits for each document, within [2^20, max_bits]."""
    return max(1 << 20, min(max_bits, 1 << max(1, n_rows * 256 - 1).bit_length()))


def _merge(once_a, twice_a, once_b, twice_b):
    return once_a | once_b, twice_a | twice_b | (once_a & once_b)


def _build(bits: int):
    def run(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        seen = False
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                keys = {line_key(x) for x in text.split(b"\n")}
                keys.discard(b"")
                if not keys:
                    continue
                seen = True
                pos = _bit_positions(keys, bits - 1)
                at, bit = (pos >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (pos & np.uint64(7)).astype(np.uint8))
                known = ((once[at] & bit) != 0).all(axis=1)
                np.bitwise_or.at(twice, at[known].ravel(), bit[known].ravel())
                # keys of one document that share all their probes are one key to the filter:
                # mark them as twice-seen, the confirmation counts exactly
                np.bitwise_or.at(once, at[~known].ravel(), bit[~known].ravel())
        if seen:
            yield from _parts(once, twice)

    return run


def _parts(once: np.ndarray, twice: np.ndarray):
    rows = defaultdict(list)
    for k in range(0, len(once), PART_BYTES):
        o, t = once[k : k + PART_BYTES], twice[k : k + PART_BYTES]
        if o.any() or t.any():
            rows["part"].append(k // PART_BYTES)
            rows["once"].append(zlib.compress(o.tobytes(), 1))
            rows["twice"].append(zlib.compress(t.tobytes(), 1))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(rows["part"], pa.int32()), pa.array(rows["once"], pa.binary()),
                                          pa.array(rows["twice"], pa.binary())], ["part", "once", "twice"])


def _merge_group(batches):
    once = twice = None
    part = None
    for batch in batches:
        for p, o, t in zip(*(c.to_pylist() for c in batch.columns[-3:]), strict=True):
            part = p
            o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
            once, twice = (o, t) if once is None else _merge(once, twice, o, t)
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(once.tobytes(), 1)], pa.binary()),
                                      pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], ["part", "once", "twice"])


def twice_seen(texts: DataFrame, max_bits: int, build=_build) -> tuple[int, dict[int, bytes]]:
    """(bits, compressed parts) of the filter of keys seen in two documents; ``build`` makes a task's two filters."""
    bits = _filter_bits(texts.count(), max_bits)
    schema = "part int, once binary, twice binary"
    parts = texts.mapInArrow(build(bits), schema)
    # a tree of two levels bounds what meets in one merging task
    level = parts.withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(32)))
    level = level.select("branch", "part", "once", "twice").groupBy("branch", "part").applyInArrow(_stream_merge, schema)
    merged = level.groupBy("part").applyInArrow(_stream_merge, schema)
    return bits, {r["part"]: bytes(r["twice"]) for r in merged.select("part", "twice").collect()}


def _stream_merge(tab: pa.Table) -> pa.Table:
    return pa.Table.from_batches(list(_merge_group(tab.select(["part", "once", "twice"]).to_batches())))


class Suspects:
    """The twice-seen filter inside a task."""

    def __init__(self, bits: int, parts: dict[int, bytes]) -> None:
        self.mask = bits - 1
        self.filter = np.zeros(bits // 8, np.uint8)
        for k, packed in parts.items():
            part = np.frombuffer(zlib.decompress(packed), np.uint8)
            self.filter[k * PART_BYTES : k * PART_BYTES + len(part)] = part

    def among(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        return self.at(_bit_positions(keys, self.mask))

    def at(self, pos: np.ndarray) -> np.ndarray:
        """Are all bits of each row of positions set?"""
        return ((self.filter[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _count_suspects(filter_ref):
    def run(batches):
        suspects = Suspects(*filter_ref.value)
        for batch in batches:
            found: dict[bytes, list] = {}
            for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                first: dict[bytes, int] = {}
                for n, line in enumerate(text.split(b"\n")):
                    if key := line_key(line):
                        first.setdefault(key, n)
                keys = list(first)
                for key, hit in zip(keys, suspects.among(keys).tolist(), strict=True):
                    if hit:
                        at = (doc is None, doc or 0, first[key])
                        if (x := found.get(key)) is None:
                            found[key] = [1, at]
                        else:
                            x[0] += 1
                            x[1] = min(x[1], at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array([x[0] for x in found.values()], pa.int64()),
                 pa.array([x[1][0] for x in found.values()], pa.bool_()), pa.array([x[1][1] for x in found.values()], pa.int64()),
                 pa.array([x[1][2] for x in found.values()], pa.int32())], ["key", "n", "no_doc", "doc", "line"])

    return run


def repeated_lines(docs: DataFrame, min_docs: int, id_col: str = "doc_id", text_col: str = "text",
                   max_bits: int = 1 << 28) -> DataFrame:
    """(key, n_docs, no_doc, doc, line): keys in at least ``min_docs`` documents with
    their first occurrence by (id, line number), null ids last. Written to the shared folder."""
    spark = docs.sparkSession
    filter_ref = spark.sparkContext.broadcast(twice_seen(docs.select(F.col(f"`{text_col}`")), max_bits))
    counted = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(
        _count_suspects(filter_ref), "key binary, n long, no_doc boolean, doc long, line int")
    confirmed = (counted.groupBy("key")
                 .agg(F.sum("n").alias("n_docs"), F.min(F.struct("no_doc", "doc", "line")).alias("first"))
                 .filter(F.col("n_docs") >= max(2, min_docs)).select("key", "n_docs", "first.*"))
    return materialise(confirmed, "repeated-lines")


def _drop(text: bytes, doc, found: dict[bytes, tuple] | None, first_stays: bool) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    if not found:
        return text, len(lines), 0
    kept = []
    for n, line in enumerate(lines):
        first = found.get(line_key(line))
        if first is None or (first_stays and first == (doc is None, doc or 0, n)):
            kept.append(line)
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


RESULT = "struct<text: string, n_lines: long, n_dropped: long>"


def _result(rows) -> pa.StructArray:
    return pa.StructArray.from_arrays(
        [pa.array([r[0].decode() for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
         pa.array([r[2] for r in rows], pa.int64())], ["text", "n_lines", "n_dropped"])


def line_dedup(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, id_col: str = "doc_id",
               text_col: str = "text", max_bits: int = 1 << 28, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with ``text_col`` rewritten and a struct column ``line_dedup``
    (n_lines before dropping, n_dropped) added (an input column of that name is replaced).

    Confirmed keys of at most ``broadcast_bytes`` (measured) go to every task. A larger
    set is joined: each distinct text's suspect keys meet the confirmed keys in
    a shuffle and return to the documents by text digest."""
    spark = docs.sparkSession
    confirmed = repeated_lines(docs, min_docs, id_col, text_col, max_bits)
    size = confirmed.agg(F.coalesce(F.sum(F.length("key") + 96), F.lit(0)).alias("b")).first()["b"]
    doc, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    if size <= broadcast_bytes:
        found_ref = spark.sparkContext.broadcast({bytes(r["key"]): (r["no_doc"], r["doc"], r["line"]) for r in confirmed.collect()})

        @F.arrow_udf(RESULT)
        def drop(ids: pa.Array, texts: pa.Array) -> pa.Array:
            found = found_ref.value
            return _result([_drop(t, d, found, keep_first) for d, t in zip(ids.to_pylist(), text_bytes(texts), strict=True)])

        out = docs.withColumn("line_dedup", drop(doc, text))
    else:
        out = _drop_by_join(docs, confirmed, doc, text, keep_first)
    dropped = F.col("line_dedup.n_dropped")
    return out.withColumn(text_col, F.when(dropped > 0, F.col("line_dedup.text")).otherwise(text)).withColumn(
        "line_dedup", F.struct("line_dedup.n_lines", "line_dedup.n_dropped"))


def _drop_by_join(docs: DataFrame, confirmed: DataFrame, doc, text, keep_first: bool) -> DataFrame:
    def keys(batches):
        for batch in batches:
            digests, found = [], []
            for digest, t in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                own = {line_key(x) for x in t.split(b"\n")} - {b""}
                digests += [digest] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(found, pa.binary())], ["digest", "key"])

    @F.arrow_udf(RESULT)
    def drop(ids: pa.Array, texts: pa.Array, hits: pa.Array) -> pa.Array:
        rows = []
        for d, t, h in zip(ids.to_pylist(), text_bytes(texts), hits.to_pylist(), strict=True):
            rows.append(_drop(t, d, {x["key"]: (x["no_doc"], x["doc"], x["line"]) for x in h or ()}, keep_first))
        return _result(rows)

    digest = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    texts = docs.select(digest.alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    per_text = (texts.mapInArrow(keys, "digest string, key binary").join(confirmed, "key")
                .groupBy("digest").agg(F.collect_list(F.struct("key", "no_doc", "doc", "line")).alias("__hits"))
                .withColumnRenamed("digest", "__digest"))
    joined = docs.withColumn("__digest", digest).join(per_text, "__digest", "left")
    return joined.withColumn("line_dedup", drop(doc, text, F.col("__hits"))).drop("__digest", "__hits")
