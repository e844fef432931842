"""Removal of repeated substrings with difference-cover suffix ranking.

A byte goes if a string of ``LENGTH`` bytes over it also starts earlier (smaller
id, or same row, earlier start), judged on the input.

1. Each window of LENGTH bytes belongs to its minimiser, the SEED-byte string
   with the smallest hash in it; equal windows have equal minimisers at equal
   offsets. A scan emits one row for each minimiser place: its hash, the digest of the
   bytes of all its windows (the context), and where it is.
2. Dealt by minimiser and sorted, a stream finds places whose whole context is earlier
   elsewhere (their windows go) and places whose minimiser has other contexts
   too. Everything else occurs once.
3. Only the snippets of the latter are suffix-sorted: dealt by minimiser, so
   that equal windows meet, each task takes chunks of whole minimisers, ranks all
   suffixes of the chunk with the difference-cover algorithm (sorted triples of a
   sample, recursion on their names, merge of the others) and compares adjacent
   prefixes of LENGTH bytes. A minimiser with more snippets than a chunk
   holds is cut into chunks; the first of each group of windows in a chunk is then
   compared across chunks by digest in a shuffle with partial aggregation.
4. The covered intervals return to their rows, which are cut.

Defined cases: null text is empty; texts under LENGTH bytes lose nothing; rows of
one id are ordered by their place in the input files; null ids come last; invalid UTF-8
may be left over, so the remaining text is binary; an empty table gives an empty table.
Rows are told apart by their file and their index in it, the same in every read; a ``docs``
that is not a Parquet table is numbered in a written copy (``common.numbered``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Joined, materialise, mix, numbered, text_bytes
from .suffix_ranks import suffix_ranks

LENGTH, SEED = 100, 50
SPAN = LENGTH - SEED + 1  # seeds in a window
SCAN_BYTES = 256 << 10
FILTER_PART = 1 << 18
LAST = (1 << 63) - 1  # in place of a null id


def _pack(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A minimiser's place with its first and last window start."""
    return at << 14 | (at - low) << 7 | (at - high)


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = place >> 14
    return at, at - (place >> 7 & 127), at - (place & 127)


def minimisers(texts: list[bytes]):
    """(text index, minimiser hash, context digest, start in its text, first and last window start) and the joined texts."""
    joined = Joined(texts)
    n = len(joined.data)
    lens = np.maximum(joined.ends - joined.starts - LENGTH + 1, 0)
    if not lens.sum():
        empty = np.empty(0, np.int64)
        return empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty, joined
    joined._sums()
    seeds = (joined._prefix[SEED:] - joined._prefix[:-SEED]) * joined._back[: n - SEED + 1]
    # smallest hash first, leftmost among equals: the place is in the lower half
    low = ((seeds * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32) << np.uint64(32)) | np.arange(len(seeds), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (SPAN - width)], low[SPAN - width :])
    begin = np.cumsum(lens) - lens
    window = np.repeat(joined.starts - begin, lens) + np.arange(int(lens.sum()))
    at = (low[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    turn = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    at, first = at[turn], window[turn]
    last = window[np.append(turn[1:], len(window)) - 1]
    text = np.searchsorted(joined.ends, at, side="right")
    context = mix(joined.hashes(first, last + LENGTH) + (at - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    base = joined.starts[text]
    return text, mix(seeds[at]), context, at - base, first - base, last - base, joined


def _pieces(texts: list[bytes], piece_bytes: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Groups of about SCAN_BYTES: (text index, offset, bytes); a long text in overlapping pieces."""
    owner, offset, part, size = [], [], [], 0
    for k, text in enumerate(texts):
        for a in range(0, max(1, len(text) - LENGTH + 1), piece_bytes):
            piece = text[a : a + piece_bytes + LENGTH - 1]
            if size and size + len(piece) > SCAN_BYTES:
                yield owner, offset, part
                owner, offset, part, size = [], [], [], 0
            owner.append(k)
            offset.append(a)
            part.append(piece)
            size += len(piece)
    if part:
        yield owner, offset, part


def _scan(batch, piece_bytes: int) -> Iterator[tuple]:
    """Minimiser places of a batch (id, row, text) by group of texts: id, row, seed, context, packed place, snippet spans."""
    ids = np.array([LAST if i is None else i for i in batch.column(0).to_pylist()], np.int64)
    rows = batch.column(1).to_numpy(zero_copy_only=False)
    for owner, offset, part in _pieces(text_bytes(batch.column(2)), piece_bytes):
        text, seed, context, at, low, high, joined = minimisers(part)
        own, shift = np.array(owner, np.int64)[text], np.array(offset, np.int64)[text]
        base = joined.starts[text]
        yield ids[own], rows[own], seed.view(np.int64), context.view(np.int64), _pack(at + shift, low + shift, high + shift), base + low, base + high + LENGTH, joined


def _batch(names: str, arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names.split())


def _emit_places(piece_bytes: int, wide: np.ndarray):
    """One row for each place; within a batch, repeats of a context after its first are ``done``:
    they need not meet the others of their minimiser. Places of a ``wide`` minimiser are dealt by their context."""
    def run(batches):
        for batch in batches:
            parts = [p[:5] for p in _scan(batch, piece_bytes)]
            if not parts:
                continue
            doc, row, seed, context, place = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((place, row, doc, context, seed))
            doc, row, seed, context, place = (c[order] for c in (doc, row, seed, context, place))
            done = np.zeros(len(doc), bool)
            done[1:] = (seed[1:] == seed[:-1]) & (context[1:] == context[:-1])
            key = np.where(np.isin(seed, wide), mix((seed ^ context).view(np.uint64)).view(np.int64), seed)
            key = np.where(done, mix((row ^ place).view(np.uint64)).view(np.int64), key)
            yield _batch("key done seed context doc row place", [key, done, seed, context, doc, row, place])

    return run


COVERED, UNSURE = 0, 1
PLACES = "key long, done boolean, seed long, context long, doc long, row long, place long"
WIDE_SHARE, WIDE_LEAST = 1000, 20
HOT_SHARE = 200
PROBES = 4


def _first_contexts(wide: np.ndarray):
    """Of places sorted by (done, seed, context, id, row, place): those whose context is earlier
    elsewhere, and the first places of contexts whose minimiser has, or if it is wide may have, several contexts."""
    return lambda batches: _firsts(batches, wide)


def _firsts(batches, wide: np.ndarray):
    before = None  # (seed, context) of the last row
    pending = None  # the last first place, with whether its minimiser already has several
    for batch in batches:
        done, seed, context, doc, row, place = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        if not len(seed):
            continue
        same_seed, same = np.zeros(len(seed), bool), np.zeros(len(seed), bool)
        same_seed[1:] = seed[1:] == seed[:-1]
        same[1:] = same_seed[1:] & (context[1:] == context[:-1])
        if before is not None:
            same_seed[0], same[0] = seed[0] == before[0], (seed[0], context[0]) == before
        same[done] = True
        if (~done).any():
            k = np.flatnonzero(~done)[-1]
            before = (seed[k], context[k])
        first = np.flatnonzero(~same)
        several_seed = [c[first] for c in (seed, doc, row, place)]
        if pending is not None:
            several_seed = [np.concatenate([[p], c]) for p, c in zip(pending[:4], several_seed, strict=True)]
        s, d, r, p = several_seed
        shared = np.isin(s, wide)
        shared[1:] |= s[1:] == s[:-1]
        shared[:-1] |= s[1:] == s[:-1]
        if pending is not None:
            shared[0] |= pending[4]
        if len(s):
            pending = (s[-1], d[-1], r[-1], p[-1], bool(shared[-1]))
        sure = np.flatnonzero(shared[:-1])
        rest = np.flatnonzero(same)
        yield _batch("kind seed doc row place", [
            np.concatenate([np.full(len(rest), COVERED, np.int32), np.full(len(sure), UNSURE, np.int32)]),
            np.concatenate([seed[rest], s[sure]]), np.concatenate([doc[rest], d[sure]]), np.concatenate([row[rest], r[sure]]), np.concatenate([place[rest], p[sure]])])
    if pending is not None and pending[4]:
        yield _batch("kind seed doc row place", [np.array([UNSURE], np.int32), *(np.array([x], np.int64) for x in pending[:4])])


def _wide_seeds(rows: DataFrame, piece_bytes: int, sample_docs: int) -> np.ndarray:
    """Minimisers with over 1/WIDE_SHARE of the places of a sample of about ``sample_docs`` documents: fewer than WIDE_SHARE.
    Which ones are found changes how places are dealt and how many snippets are compared, never what is removed."""
    share = min(1.0, sample_docs / max(1, rows.count()))
    drawn = rows.sample(share, 7) if share < 1 else rows
    counts = materialise(drawn.mapInArrow(_emit_places(piece_bytes, np.zeros(0, np.int64)), PLACES).filter("NOT done").groupBy("seed").count(), "substring-seeds")
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()["n"]
    found = counts.filter((F.col("count") > WIDE_LEAST) & (F.col("count") * WIDE_SHARE > total)).select("seed").collect()
    return np.array([r["seed"] for r in found], np.int64)


def _slots(row: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
    x = mix(row.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.view(np.uint64))
    step = (x >> np.uint64(32)) | np.uint64(1)
    return ((x + step * np.arange(PROBES, dtype=np.uint64)[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def _place_filter(unsure: DataFrame, max_bits: int) -> tuple[int, dict[int, bytes]]:
    """Bloom filter of the unsure places, of bounded size; a false positive only adds a snippet."""
    bits = max(1 << 20, min(max_bits, 1 << (16 * unsure.count()).bit_length()))

    def build(batches):
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            slot = _slots(*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)), bits).ravel()
            np.bitwise_or.at(own, slot >> 3, np.uint8(1) << (slot & 7).astype(np.uint8))
        parts = [(k // FILTER_PART, own[k : k + FILTER_PART]) for k in range(0, len(own), FILTER_PART)]
        parts = [(k, zlib.compress(p.tobytes(), 1)) for k, p in parts if p.any()]
        yield _batch("part packed", [pa.array([k for k, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())])

    def merge(tab: pa.Table) -> pa.Table:
        out = None
        for packed in tab.column("packed").to_pylist():
            p = np.frombuffer(zlib.decompress(packed), np.uint8)
            out = p if out is None else out | p
        return pa.table({"part": pa.array([tab.column("part")[0].as_py()], pa.int32()), "packed": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})

    schema = "part int, packed binary"
    parts = unsure.select("row", "place").mapInArrow(build, schema)
    level = parts.withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(32))).groupBy("branch", "part").applyInArrow(
        lambda t: merge(t.select(["part", "packed"])), schema)
    return bits, {r["part"]: bytes(r["packed"]) for r in level.groupBy("part").applyInArrow(merge, schema).collect()}


def _emit_snippets(ref, hot: dict[int, int], piece_bytes: int):
    def run(batches):
        bits, parts = ref.value
        member = np.zeros(bits // 8, np.uint8)
        for k, packed in parts.items():
            p = np.frombuffer(zlib.decompress(packed), np.uint8)
            member[k * FILTER_PART : k * FILTER_PART + len(p)] = p
        for batch in batches:
            for doc, row, seed, _, place, low, high, joined in _scan(batch, piece_bytes):
                slot = _slots(row, place, bits)
                found = np.flatnonzero(((member[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).all(axis=0))
                if not len(found):
                    continue
                cuts = [joined.raw[a:b] for a, b in zip(low[found].tolist(), high[found].tolist(), strict=True)]
                spread = mix(row[found].view(np.uint64)) >> np.uint64(1)  # of the row: common texts may stand at regular places
                salt = [r % hot[s] + 1 if s in hot else 0 for r, s in zip(spread.tolist(), seed[found].tolist(), strict=True)] if hot else np.zeros(len(found), np.int64)
                yield _batch("salt seed doc row place snippet", [
                    np.asarray(salt, np.int64), seed[found], doc[found], row[found], place[found], pa.array(cuts, pa.binary())])

    return run


def repeated_windows(snippets: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(snippet, start in it, group) of every window of LENGTH bytes; equal windows have one group."""
    joined = Joined(snippets, sep=b"\0")
    lens = joined.ends - joined.starts - LENGTH + 1
    owner = np.repeat(np.arange(len(snippets)), lens)
    start = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    at = joined.starts[owner] + start
    order = np.argsort(suffix_ranks(joined.data.astype(np.int64) + 1, LENGTH)[at], kind="stable")
    new = np.ones(len(at), bool)
    offsets = np.arange(LENGTH)
    for a in range(1, len(order), 1 << 14):  # adjacent prefixes, block by block
        b = min(len(order), a + (1 << 14))
        here, prior = at[order[a:b]], at[order[a - 1 : b - 1]]
        new[a:b] = (joined.data[here[:, None] + offsets] != joined.data[prior[:, None] + offsets]).any(axis=1)
    group = np.empty(len(at), np.int64)
    group[order] = np.cumsum(new)
    return owner, start, group


def _resolve(rows: list[tuple], partial: bool):
    """Result rows of a chunk sorted by (id, row, place) within each minimiser."""
    doc, row, place = (np.array([r[k] for r in rows], np.int64) for k in (2, 3, 4))
    seed = np.array([r[1] for r in rows], np.int64)
    owner, start, group = repeated_windows([r[5] for r in rows])
    low = _unpack(place)[1]
    turn = np.empty(len(rows), np.int64)
    turn[np.lexsort((place, row, doc))] = np.arange(len(rows))
    when = turn[owner] * (SPAN + 1) + start  # order of the windows in the corpus
    earliest = np.full(int(group.max()) + 1, len(rows) * (SPAN + 1), np.int64)
    np.minimum.at(earliest, group, when)
    repeat = earliest[group] != when
    cover = np.flatnonzero(repeat)
    runs = np.ones(len(cover), bool)
    runs[1:] = (owner[cover[1:]] != owner[cover[:-1]]) | (start[cover[1:]] != start[cover[:-1]] + 1)
    first = cover[runs]
    last = cover[np.append(np.flatnonzero(runs)[1:], len(cover)) - 1] if len(cover) else first
    begin, end = low[owner[first]] + start[first], low[owner[last]] + start[last] + LENGTH
    out = [(row[owner[first]], begin, end, np.zeros(len(first), bool), np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), doc[owner[first]])]
    if partial:
        lone = np.flatnonzero(~repeat)
        joined = Joined([r[5] for r in rows], sep=b"\0")
        at = joined.starts[owner[lone]] + start[lone]
        begin = low[owner[lone]] + start[lone]
        digest = joined.hashes(at, at + LENGTH).view(np.int64)
        out.append((row[owner[lone]], begin, begin + LENGTH, np.ones(len(lone), bool), seed[owner[lone]], digest, doc[owner[lone]]))
    yield _batch("row begin end open seed digest doc", [np.concatenate(c) for c in zip(*out, strict=True)])


def _rank_chunks(chunk_bytes: int):
    """Over rows sorted by (salt, seed, id, row, place): chunks of whole minimisers, or parts of a hot one."""
    return lambda batches: _ranked(batches, chunk_bytes)


def _ranked(batches, chunk_bytes: int):
    chunk, size, split = [], 0, False  # split: the chunk is part of one minimiser only
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = r[:2]
            if chunk and size + len(r[5]) > chunk_bytes:
                if chunk[0][:2] == chunk[-1][:2] == key:  # one minimiser fills the chunk
                    yield from _resolve(chunk, True)
                    chunk, size, split = [], 0, True
                elif chunk[-1][:2] != key:
                    yield from _resolve(chunk, split or chunk[-1][0] > 0)
                    chunk, size, split = [], 0, False
                else:  # the last minimiser goes on: it moves to the next chunk
                    k = next(i for i, x in enumerate(chunk) if x[:2] == key)
                    yield from _resolve(chunk[:k], split or chunk[k - 1][0] > 0)
                    chunk, split = chunk[k:], False
                    size = sum(len(x[5]) for x in chunk)
            chunk.append(r)
            size += len(r[5])
    if chunk:
        yield from _resolve(chunk, split or chunk[-1][0] > 0)


RESULT = "struct<kept: binary, n_bytes: long, n_removed: long, n_spans: long>"


def _cut(text: bytes, begin: list[int], end: list[int]) -> tuple[bytes, int, int]:
    kept, at, spans, removed = [], 0, 0, 0
    reach = -1
    for a, b in sorted(zip(begin, end, strict=True)):
        if a > reach:
            kept.append(text[at:a])
            spans += 1
            removed += b - a
            at = reach = b
        elif b > reach:
            removed += b - reach
            at = reach = b
    kept.append(text[at:])
    return b"".join(kept), removed, spans


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "deduplicated", max_filter_bits: int = 1 << 28,
                    chunk_bytes: int = 512 << 10, hot_snippets: int = 50_000, piece_bytes: int = 4 << 20, hot_least: int = 1000,
                    sample_docs: int = 5000) -> DataFrame:
    """``docs`` with a struct column: kept (remaining bytes), n_bytes, n_removed, n_spans (maximal removed runs).

    ``chunk_bytes`` of snippets are suffix-sorted together; minimisers of more than ``hot_snippets``
    (or of 1/HOT_SHARE of all and over ``hot_least``) are dealt to several tasks; texts are scanned in pieces of ``piece_bytes``
    windows; minimisers that a sample of ``sample_docs`` documents shows to be common are dealt by context at once."""
    spark = docs.sparkSession
    row_id = "__substring_row"
    whole = numbered(docs, row_id)  # the same numbers in each of the three reads
    rows = whole.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(row_id).alias("row"), F.col(f"`{text_col}`").alias("text"))

    wide = _wide_seeds(rows, piece_bytes, sample_docs)
    places = rows.mapInArrow(_emit_places(piece_bytes, wide), PLACES)
    sorted_places = places.repartition("key").sortWithinPartitions("done", "seed", "context", "doc", "row", "place").drop("key")
    known = materialise(sorted_places.mapInArrow(_first_contexts(wide), "kind int, seed long, doc long, row long, place long"), "substring-places")
    unsure = known.filter(F.col("kind") == UNSURE)
    covered = known.filter(F.col("kind") == COVERED).select(
        "row", (F.expr("(place >> 14) - ((place >> 7) & 127)")).alias("begin"), F.expr(f"(place >> 14) - (place & 127) + {LENGTH}").alias("end"))

    ref = spark.sparkContext.broadcast(_place_filter(unsure, max_filter_bits))
    # a minimiser of many snippets is split: over hot_snippets, or over 1/HOT_SHARE of all and not just a few
    limit = min(hot_snippets, max(hot_least, unsure.count() // HOT_SHARE))
    counts = unsure.groupBy("seed").count().filter(F.col("count") > limit).collect()  # fewer than HOT_SHARE or one for hot_snippets rows
    hot = {r["seed"]: -(-r["count"] // limit) for r in counts}
    snippets = rows.mapInArrow(_emit_snippets(ref, hot, piece_bytes), "salt long, seed long, doc long, row long, place long, snippet binary")
    dealt = snippets.repartition("salt", "seed").sortWithinPartitions("salt", "seed", "doc", "row", "place")
    ranked = materialise(dealt.mapInArrow(_rank_chunks(chunk_bytes), "row long, begin long, end long, open boolean, seed long, digest long, doc long"), "substring-ranked")
    opened = ranked.filter("open")
    first = opened.groupBy("seed", "digest").agg(F.min(F.struct("doc", "row", "begin")).alias("first"))
    late = opened.join(first, ["seed", "digest"]).filter(F.struct("doc", "row", "begin") > F.col("first"))
    spans = covered.unionByName(ranked.filter("NOT open").select("row", "begin", "end")).unionByName(late.select("row", "begin", "end"))
    per_row = spans.groupBy("row").agg(F.collect_list("begin").alias("__begin"), F.collect_list("end").alias("__end")).withColumnRenamed("row", row_id)

    @F.arrow_udf(RESULT)
    def cut(texts: pa.Array, begin: pa.Array, end: pa.Array) -> pa.Array:
        own = text_bytes(texts)
        found = [_cut(t, a or [], b or []) for t, a, b in zip(own, begin.to_pylist(), end.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.binary()), pa.array([len(t) for t in own], pa.int64()),
             pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())], ["kept", "n_bytes", "n_removed", "n_spans"])

    joined = whole.join(per_row, row_id, "left")
    return joined.withColumn(out_col, cut(F.col(f"`{text_col}`"), F.col("__begin"), F.col("__end"))).drop(row_id, "__begin", "__end")
