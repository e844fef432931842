"""Exact nearest neighbours among a large reference side: a pivot tree, searched in rounds.

1. Equal reference vectors become one row with their ``k + 1`` smallest keys (nothing else of them can be
   among the k nearest), so copies that hold a third of all rows cost one row.
2. A tree of hyperplanes whose depth follows the number of rows is grown on the driver from a bounded sample
   (``SAMPLE_PER_LEAF`` rows a leaf, the tree within ``TREE_BYTES``). It deals *all* reference rows to its leaves; one
   aggregate measures the ball of each leaf, inner nodes enclose the balls below.
3. Each query row first meets its own leaf. Its k-th distance then bounds the search: a subtree
   whose ball is farther is skipped whole. The nearest unvisited leaves are met next, ``FIRST_TAKE`` of them,
   then ``GROWTH`` times as many, each time under the bound of the round before, until no row has a
   leaf within its bound. Rows that are done leave the rounds.
4. A row whose open leaves hold over 1/``WIDE`` of the reference rows, or as many as ``NEAR_LEAVES`` leaves, is one that
   the tree cannot narrow: dealing it to each leaf would shuffle its vector once a leaf, the more often the more
   leaves there are. Such rows leave the rounds with their bound. Packed to blocks of about ``BLOCK_BYTES`` they meet the
   reference rows, packed leaf by leaf, in a cross join of the two files, which shuffles no vector. In a pair of blocks
   a row meets only those leaves whose ball its bound reaches; the rows within the bound, ``k`` a block at most, are shuffled.

A round deals query rows to leaves and meets the leaf's rows in ``cogroup`` tasks of at most about ``QUERY_ROWS`` by
``block_rows`` rows; only k-best lists come out. Rounds are Parquet tables in the shared
folder, so a lost executor repeats its own tasks of one round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_shared

SAMPLE_PER_LEAF = 16
TREE_BYTES = 32 << 20
QUERY_ROWS = 16_384
FIRST_TAKE, GROWTH = 4, 4
CHUNK_ROWS = 50_000
WIDE = 8
NEAR_LEAVES = 8
BLOCK_BYTES = 8 << 20
STRIP = 1 << 22  # numbers of a matrix of pairs at once
AXES, SIFT, TILE = 16, 200, 512

STATE = "key long, vec array<double>, best array<struct<distance: double, neighbour: long>>, visited array<int>, leaves array<int>, open long"


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lists(lens: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lens))), pa.int32()), values)


def in_tables(batches: Iterator[pa.RecordBatch], most: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """Batches joined to tables of about ``most`` rows: a walk through the tree pays for many rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _distance(X: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((X - point) ** 2).sum(1))


class PivotTree:
    """Nodes are [centre, normal, offset, below, above]; a leaf has its number instead of a normal."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.nodes: list[list] = [[]]
        self.leaf_nodes: list[int] = []
        stack = [(0, sample, leaves)]
        while stack:
            node, rows, parts = stack.pop()
            centre = rows.mean(axis=0) if len(rows) else np.zeros(rows.shape[1])
            cut = self._cut(rows, centre) if parts > 1 and len(rows) > 1 else None
            if cut is None:
                self.nodes[node] = [centre, len(self.leaf_nodes)]
                self.leaf_nodes.append(node)
                continue
            normal, offset, side = cut
            below = len(self.nodes)
            self.nodes[node] = [centre, normal, offset, below, below + 1]
            self.nodes += [[], []]
            stack += [(below, rows[side], parts // 2), (below + 1, rows[~side], parts - parts // 2)]
        self.radius, self.count = np.zeros(len(self.nodes)), np.zeros(len(self.leaf_nodes), np.int64)

    @staticmethod
    def _cut(rows: np.ndarray, centre: np.ndarray):
        """A plane across the line of two far points, at the median or, where ties forbid it, between the ends."""
        a = rows[_distance(rows, centre).argmax()]
        b = rows[_distance(rows, a).argmax()]
        along = rows @ (b - a)
        for offset in (float(np.median(along)), float((along.min() + along.max()) / 2)):
            side = along <= offset
            if 0 < side.sum() < len(rows):
                return b - a, offset, side
        return None

    def enclose(self, radius: dict[int, float], count: dict[int, int]) -> None:
        """Balls of the leaves as measured; an inner node's ball holds those below."""
        for leaf, node in enumerate(self.leaf_nodes):
            self.radius[node], self.count[leaf] = radius.get(leaf, 0.0), count.get(leaf, 0)
        for node in range(len(self.nodes) - 1, -1, -1):  # children come after their parent
            if len(self.nodes[node]) > 2:
                self.radius[node] = max(_distance(self.nodes[c][0][None], self.nodes[node][0])[0] + self.radius[c] for c in self.nodes[node][3:])

    def home(self, X: np.ndarray) -> np.ndarray:
        """The leaf that each row falls into."""
        out = np.zeros(len(X), np.int32)
        stack = [(0, np.arange(len(X)))]
        while stack:
            node, rows = stack.pop()
            at = self.nodes[node]
            if len(at) == 2:
                out[rows] = at[1]
                continue
            side = X[rows] @ at[1] <= at[2]
            stack += [(child, part) for child, part in ((at[3], rows[side]), (at[4], rows[~side])) if len(part)]
        return out

    def centres(self) -> np.ndarray:
        return np.stack([self.nodes[n][0] for n in self.leaf_nodes])

    def within(self, X: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, lower bound of the distance) of the leaves that can hold a row within ``bound``."""
        rows_, leaves, lows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        slack = bound * (1 + 1e-9) + 1e-9
        stack = [(0, np.arange(len(X)))]
        while stack:
            node, rows = stack.pop()
            at = self.nodes[node]
            if len(at) == 2 and not self.count[at[1]]:
                continue
            low = _distance(X[rows], at[0]) - self.radius[node]
            near = low <= slack[rows]
            rows, low = rows[near], low[near]
            if not len(rows):
                continue
            if len(at) == 2:
                rows_.append(rows)
                leaves.append(np.full(len(rows), at[1]))
                lows.append(low)
            else:
                stack += [(child, rows) for child in at[3:]]
        return np.concatenate(rows_), np.concatenate(leaves), np.concatenate(lows)


# ---------------------------------------------------------------- distinct reference vectors


def _fewest_keys(most: int):
    """Rows (vec, keys): the ``most`` smallest keys of each vector of a chunk."""

    def run(batches):
        for rows in in_tables(batches):
            X = np.ascontiguousarray(matrix(rows["vec"])) + 0.0  # no negative zero
            keys = rows["key"].to_numpy()
            _, group = np.unique(X.view(np.dtype((np.void, X.itemsize * X.shape[1]))).ravel(), return_inverse=True)
            order = np.lexsort((keys, group))
            group = group[order]
            place = np.arange(len(group)) - np.searchsorted(group, group)
            kept = order[place < most]
            first = order[place == 0]
            lens = np.minimum(np.bincount(group), most)
            width = np.full(len(first), X.shape[1])
            yield pa.RecordBatch.from_arrays([lists(width, pa.array(X[first].ravel())), lists(lens, pa.array(keys[kept], pa.int64()))], ["vec", "keys"])

    return run


def distinct_vectors(ref: DataFrame, most: int) -> DataFrame:
    """(vec, keys): every distinct vector once with its ``most`` smallest keys, in order; written to the shared folder."""
    partial = ref.select("key", "vec").mapInArrow(_fewest_keys(most), "vec array<double>, keys array<long>")
    merged = partial.groupBy("vec").agg(F.slice(F.array_sort(F.flatten(F.collect_list("keys"))), 1, most).alias("keys"))
    return write_shared(merged, "knn-vectors")


# ---------------------------------------------------------------- rounds


def grow(vectors: DataFrame, n: int, block_rows: int) -> PivotTree:
    width = vectors.select(F.size("vec").alias("d")).first()["d"]
    leaves = max(1, min(math.ceil(n / block_rows), TREE_BYTES // (32 * width)))
    share = min(1.0, leaves * SAMPLE_PER_LEAF / n)
    draw = F.pmod(F.xxhash64("vec", F.lit("knn")), F.lit(1 << 40)) / float(1 << 40)
    sample = vectors.select("vec") if share == 1.0 else vectors.filter(draw < share).select("vec")
    rows = matrix(sample.toArrow()["vec"])  # of about SAMPLE_PER_LEAF rows a leaf
    return PivotTree(rows if len(rows) else np.zeros((0, width)), leaves)


def _dealt(tree_ref):
    def run(batches):
        tree = tree_ref.value
        centres = tree.centres()
        for rows in in_tables(batches):
            X = matrix(rows["vec"])
            leaf = tree.home(X)
            dist = np.sqrt(((X - centres[leaf]) ** 2).sum(1))
            yield from rows.append_column("leaf", pa.array(leaf, pa.int32())).append_column("dist", pa.array(dist)).to_batches()

    return run


def _at_home(tree_ref):
    def run(batches):
        tree = tree_ref.value
        for rows in in_tables(batches):
            n = rows.num_rows
            none = np.zeros(n, np.int64)
            kind = pa.struct([("distance", pa.float64()), ("neighbour", pa.int64())])
            home = pa.array(tree.home(matrix(rows["vec"])), pa.int32())
            yield from pa.table({"key": rows["key"], "vec": rows["vec"], "best": lists(none, pa.array([], kind)),
                                 "visited": lists(none, pa.array([], pa.int32())), "leaves": lists(none + 1, home),
                                 "open": none}).to_batches()

    return run


def _next_leaves(tree_ref, k: int, take: int):
    """Replaces ``leaves`` by the nearest unvisited ones within the bound; those of the round before are visited. ``open``
    is how many reference rows all unvisited ones within it hold (0 as long as a row has no bound)."""

    def run(batches):
        tree = tree_ref.value
        n_leaves = len(tree.leaf_nodes)
        for table in in_tables(batches):
            step = max(1, STRIP // n_leaves)
            for rows in (table.slice(s, step).combine_chunks() for s in range(0, table.num_rows, step)):
                n = rows.num_rows
                best, visited = (pa.concat_arrays(rows[c].chunks) for c in ("best", "visited"))
                ends, lens = best.offsets.to_numpy(), best.value_lengths().to_numpy(zero_copy_only=False)
                distance = best.values.field("distance").to_numpy(zero_copy_only=False)
                bound = np.full(n, np.inf)
                full = lens == k
                bound[full] = distance[ends[1:][full] - 1]
                row, leaf, low = tree.within(matrix(rows["vec"]), bound)
                seen_row = np.repeat(np.arange(n), visited.value_lengths().to_numpy(zero_copy_only=False))
                new = ~np.isin(row * n_leaves + leaf, seen_row * n_leaves + visited.flatten().to_numpy(zero_copy_only=False))
                row, leaf, low = row[new], leaf[new], low[new]
                still = np.where(full, np.bincount(row, weights=tree.count[leaf], minlength=n), 0).astype(np.int64)
                order = np.lexsort((leaf, low, row))
                row, leaf = row[order], leaf[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < take
                chosen = lists(np.bincount(row[first], minlength=n), pa.array(leaf[first], pa.int32()))
                rows = rows.set_column(rows.column_names.index("leaves"), "leaves", chosen)
                yield from rows.append_column("open", pa.array(still)).to_batches()

    return run


def _meeting(parts_ref, per_row: bool):
    """Rows repeated for the blocks they meet: (leaf, qb, rb, ...). A leaf's query rows are cut into parts q, its
    reference rows into parts r; part numbers come from the row's own hash."""

    def run(batches):
        q_parts, r_parts = parts_ref.value
        own, other, own_name, other_name = (q_parts, r_parts, "qb", "rb") if per_row else (r_parts, q_parts, "rb", "qb")
        for rows in in_tables(batches):
            leaf = rows["leaf"].to_numpy().astype(np.int64)
            part = rows["spread"].to_numpy() % np.maximum(own[leaf], 1)
            times = other[leaf]
            at = np.repeat(np.arange(len(leaf)), times)
            if not len(at):
                continue
            ends = np.cumsum(times)
            block = np.arange(len(at)) - np.repeat(ends - times, times)
            kept = rows.drop_columns(["leaf", "spread"]).take(pa.array(at))
            for name, values in (("leaf", leaf[at]), (own_name, part[at]), (other_name, block)):
                kept = kept.append_column(name, pa.array(values, pa.int32()))
            yield from kept.to_batches(max_chunksize=CHUNK_ROWS)

    return run


def _keyed(asked: np.ndarray, row: np.ndarray, at: np.ndarray, distance: np.ndarray, keys, k: int, exclude_self: bool) -> pa.Table:
    """The k nearest rows of each row ``asked`` (by its place ``row``) among the keys of the vectors ``at``; ties by key.
    ``keys``: (start of a vector's keys, their number, all keys)."""
    start, lens, flat = keys
    n = lens[at]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row, distance, near = np.repeat(row, n), np.repeat(distance, n), flat[np.repeat(start[at], n) + within]
    asked = asked[row]
    if exclude_self:
        other = asked != near
        row, distance, near, asked = row[other], distance[other], near[other], asked[other]
    order = np.lexsort((near, distance, row))
    row = row[order]
    kept = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
    return pa.table({"key": pa.array(asked[kept], pa.int64()), "neighbour": pa.array(near[kept], pa.int64()), "distance": pa.array(distance[kept])})


def _best_pairs(k: int, exclude_self: bool, counted):
    from .knn import topk_rows

    most = k + 1 if exclude_self else k

    def run(query: pa.Table, ref: pa.Table) -> pa.Table:
        if not query.num_rows or not ref.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        if counted is not None:
            counted.add(query.num_rows * ref.num_rows)
        keys = ref["keys"].combine_chunks()
        start, lens = keys.offsets.to_numpy(), keys.value_lengths().to_numpy(zero_copy_only=False)
        flat = keys.values.to_numpy(zero_copy_only=False)
        low = flat[start[:-1]]
        order = np.argsort(low)
        row, at, distance = topk_rows(matrix(query["vec"]), low[order], matrix(ref["vec"])[order], most)
        return _keyed(query["key"].to_numpy(), row, order[at], distance, (start, lens, flat), k, exclude_self)

    return run


# ---------------------------------------------------------------- rows that the tree cannot narrow


def within_bound(Q: np.ndarray, bound: np.ndarray, R: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of Q, row of R, distance): at least the ``most`` nearest rows of R, and all that tie with them, among those
    within ``bound`` of a row of Q.

    |q - r|² <= bound² where q·r - |r|²/2 >= (|q|² - bound²)/2: one product in single precision, less its largest
    possible error, leaves few pairs, whose distances are then taken in full. Strips in which that error hides more
    pairs than are wanted take the product in double precision. Where few axes tell most pairs apart (``sifted``) the
    product of all columns is not taken."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    known = np.flatnonzero(np.isfinite((R * R).sum(1)))
    if not len(known) or not len(Q):
        return parts[0]
    centre = R[known].mean(axis=0)
    q, r = Q - centre, R[known] - centre  # small numbers round less
    with np.errstate(invalid="ignore", over="ignore"):
        moved = 8 * np.finfo(float).eps * np.abs(Q).max(axis=1, initial=0.0) + 8 * np.finfo(float).eps * np.abs(R[known]).max()
        bound = bound * (1 + 1e-9) + moved * np.sqrt(Q.shape[1])
        qn, rn = (q * q).sum(1), (r * r).sum(1)
        least = (qn - bound * bound) / 2
        terms = np.sqrt(qn * rn.max()) + rn.max() + qn + bound * bound
    left, right = np.column_stack([q, np.ones(len(q))]), np.column_stack([r, -rn / 2]).T
    finite = terms[np.isfinite(terms)]
    single = len(finite) == len(terms) and 1e-20 < terms.min() and terms.max() < 1e30
    few = sifted(q, bound, r) if single else None
    if few is not None:
        row, at = few[0], known[few[1]]
        distance = _pair_distances(Q, R, row, at)
        near = distance <= bound[row]
        return row[near], at[near], distance[near]
    step = max(1, STRIP // len(known))
    right_single = right.astype(np.float32) if single else None
    for s in range(0, len(Q), step):
        e = slice(s, s + step)
        for kind, other in ((np.float32, right_single), (np.float64, right)):
            if other is None:
                continue
            error = (Q.shape[1] + 16) * np.finfo(kind).eps * terms[e]
            score = left[e].astype(kind) @ other
            flat = np.flatnonzero(score >= (least[e] - error).astype(kind)[:, None])
            row, at = np.divmod(flat, score.shape[1])
            value = score.ravel()[flat]
            if len(row) > most:  # a row's best ``most`` and all that may tie with them
                order = np.lexsort((-value, row))
                row, at, value = row[order], at[order], value[order]
                first, n = np.unique(row, return_index=True)[1], np.bincount(row, minlength=len(score))
                n = n[n > 0]
                last = value[first + np.minimum(n, most) - 1].astype(float)
                kept = value >= np.repeat(last, n) - 2 * error[row]
                row, at = row[kept], at[kept]
            if kind is np.float64 or len(row) <= 16 * most * len(score):
                break
        row, at = row + s, known[at]
        distance = _pair_distances(Q, R, row, at)
        near = np.isfinite(distance)
        parts.append((row[near], at[near], distance[near]))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _pair_distances(Q: np.ndarray, R: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    distance = np.empty(len(row))
    for a in range(0, len(row), 1 << 16):
        distance[a:a + (1 << 16)] = np.sqrt(((R[at[a:a + (1 << 16)]] - Q[row[a:a + (1 << 16)]]) ** 2).sum(1))
    return distance


def sifted(q: np.ndarray, bound: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(row of q, row of r): all pairs within ``bound`` and some others. The distance along the AXES principal axes of r is
    never more than the whole one; its product is taken in tiles that stay in the processor's cache, rows of r of
    like norm together, since the largest sets the rounding error. None where over 1/SIFT of the pairs are left."""
    moments = r.T @ r
    if r.shape[1] <= 2 * AXES or not np.isfinite(moments).all() or not np.isfinite(bound).all():
        return None
    axes = np.linalg.eigh(moments)[1][:, -AXES:]
    p, s = q @ axes, r @ axes
    pn, sn = (p * p).sum(1), (s * s).sum(1)
    order = np.argsort(sn)
    s, sn = s[order], sn[order]
    left, right = np.column_stack([p, np.ones(len(p))]).astype(np.float32), np.column_stack([s, -sn / 2]).astype(np.float32)
    found, left_over = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], len(q) * len(r) // SIFT
    for a in range(0, len(r), TILE):
        tile, most = right[a:a + TILE].T.copy(), sn[a:a + TILE][-1]
        error = (AXES + 16) * np.finfo(np.float32).eps * (np.sqrt(pn * most) + most + pn + bound * bound)
        least = ((pn - bound * bound) / 2 - error).astype(np.float32)[:, None]
        for b in range(0, len(q), TILE):
            near = left[b:b + TILE] @ tile >= least[b:b + TILE]
            if near.any():
                row, at = np.divmod(np.flatnonzero(near), near.shape[1])
                found.append((row + b, order[at + a]))
                left_over -= len(row)
        if left_over < 0:
            return None
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


QUERY_BLOCK, REF_BLOCK = "qkeys binary, qvecs binary, qbound binary", "rvecs binary, rkeys binary, rlens binary, rleaves binary"


def _query_blocks(rows_a_block: int):
    """A partition's rows as few rows of packed columns."""

    def run(batches):
        for rows in in_tables(batches, rows_a_block):
            yield pa.record_batch([pa.array([c.tobytes()], pa.binary()) for c in (
                rows["key"].to_numpy(), matrix(rows["vec"]).astype(float), rows["bound"].to_numpy())], ["qkeys", "qvecs", "qbound"])

    return run


def _ref_blocks(rows_a_block: int):
    def run(batches):
        for rows in in_tables(batches, rows_a_block):
            keys = rows["keys"].combine_chunks()
            yield pa.record_batch([pa.array([c.tobytes()], pa.binary()) for c in (
                matrix(rows["vec"]).astype(float), keys.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                keys.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32),
                rows["leaf"].to_numpy().astype(np.int32))], ["rvecs", "rkeys", "rlens", "rleaves"])

    return run


def reaching(Q: np.ndarray, bound: np.ndarray, R: np.ndarray) -> np.ndarray:
    """Rows of Q whose bound reaches the ball around R; rows that are not numbers are among them."""
    with np.errstate(invalid="ignore", over="ignore"):
        centre = R.mean(axis=0)
        far, radius = _distance(Q, centre), _distance(R, centre).max()
        slack = bound * (1 + 1e-9) + 1e-12 * (far + radius + np.abs(centre).max())
        return np.flatnonzero(~(far - radius > slack))


def _meet_blocks(k: int, exclude_self: bool, width: int, counted):
    most = k + 1 if exclude_self else k
    kinds = {"qkeys": np.int64, "qvecs": float, "qbound": float, "rvecs": float, "rkeys": np.int64, "rlens": np.int32, "rleaves": np.int32}

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                held = {c: np.frombuffer(batch.column(c)[at].as_buffer(), kind) for c, kind in kinds.items()}
                Q, R, lens = held["qvecs"].reshape(-1, width), held["rvecs"].reshape(-1, width), held["rlens"].astype(np.int64)
                starts = np.flatnonzero(np.diff(held["rleaves"], prepend=-1))
                parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
                for a, b in zip(starts, [*starts[1:], len(R)], strict=True):  # the block's leaves
                    rows = reaching(Q, held["qbound"], R[a:b])
                    if counted is not None:
                        counted.add(len(rows) * int(b - a))
                    row, near, distance = within_bound(Q[rows], held["qbound"][rows], R[a:b], most)
                    parts.append((rows[row], near + a, distance))
                found = (np.concatenate(c) for c in zip(*parts, strict=True))
                yield from _keyed(held["qkeys"], *found, (np.cumsum(lens) - lens, lens, held["rkeys"]), k, exclude_self).to_batches()

    return run


def _by_blocks(wide: DataFrame, ref: DataFrame, n: int, width: int, k: int, exclude_self: bool, counted) -> DataFrame:
    """(key, best) of the rows ``wide`` (key, vec, bound) among all reference vectors ``ref`` (leaf, spread, vec, keys)."""
    rows_a_block = max(1, BLOCK_BYTES // (8 * max(1, width)))
    most = rows_a_block + rows_a_block // 4  # parts by hash differ a little
    asked = write_shared(wide, "knn-wide")
    q = asked.repartition(max(1, math.ceil(asked.count() / rows_a_block)), "key").mapInArrow(_query_blocks(most), QUERY_BLOCK)
    r = ref.repartitionByRange(max(1, math.ceil(n / rows_a_block)), "leaf", "spread").sortWithinPartitions("leaf").mapInArrow(_ref_blocks(most), REF_BLOCK)
    pairs = write_shared(q, "knn-query-blocks").crossJoin(write_shared(r, "knn-blocks"))
    near = pairs.mapInArrow(_meet_blocks(k, exclude_self, width, counted), "key long, neighbour long, distance double")
    best = near.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, k).alias("best"))
    return asked.select("key").join(write_shared(best, "knn-near"), "key")


def knn_by_tree(q: DataFrame, r: DataFrame, k: int, exclude_self: bool, block_rows: int, counted=None) -> DataFrame:
    """(key, neighbour, rank, distance) for ``q`` and ``r`` (key, vec). ``counted``, an accumulator, is told the row
    pairs whose distance was taken."""
    sc = q.sparkSession.sparkContext
    vectors = distinct_vectors(r, k + 1 if exclude_self else k)
    n = vectors.count()
    none = "key long, neighbour long, rank int, distance double"
    if not n:
        return q.sparkSession.createDataFrame([], none)
    tree = grow(vectors, n, block_rows)
    ref = write_shared(vectors.mapInArrow(_dealt(sc.broadcast(tree)), "vec array<double>, keys array<long>, leaf int, dist double"), "knn-leaves")
    balls = ref.groupBy("leaf").agg(F.max("dist").alias("radius"), F.count("*").alias("n")).collect()  # one row a leaf
    tree.enclose({b["leaf"]: b["radius"] for b in balls}, {b["leaf"]: b["n"] for b in balls})
    tree_ref = sc.broadcast(tree)
    ref = ref.select("leaf", F.abs(F.xxhash64("vec") % (1 << 30)).alias("spread"), "vec", "keys")
    most_open = min(n // WIDE, NEAR_LEAVES * block_rows)
    state, done, wide, take = q.mapInArrow(_at_home(tree_ref), STATE), [], [], FIRST_TAKE
    while True:
        state = write_shared(state, "knn-round")
        done.append(state.filter(F.size("leaves") == 0).select("key", "best"))
        left = F.size("leaves") > 0
        wide.append(state.filter(left & (F.col("open") > most_open)).select("key", "vec", F.element_at("best", k).getField("distance").alias("bound")))
        asked = state.filter(left & (F.col("open") <= most_open))
        visits = asked.select("key", "vec", F.abs(F.xxhash64("key") % (1 << 30)).alias("spread"), F.explode("leaves").alias("leaf"))
        wanted = {x["leaf"]: x["count"] for x in visits.groupBy("leaf").count().collect()}  # one row a leaf
        if not wanted:
            break
        q_parts = np.array([math.ceil(wanted.get(leaf, 0) / QUERY_ROWS) for leaf in range(len(tree.count))])
        r_parts = np.ceil(tree.count / block_rows).astype(np.int64)
        parts = sc.broadcast((q_parts, r_parts))
        qx = visits.mapInArrow(_meeting(parts, True), "key long, vec array<double>, leaf int, qb int, rb int")
        rx = ref.mapInArrow(_meeting(parts, False), "vec array<double>, keys array<long>, leaf int, rb int, qb int")
        found = qx.groupBy("leaf", "qb", "rb").cogroup(rx.groupBy("leaf", "qb", "rb")).applyInArrow(
            _best_pairs(k, exclude_self, counted), "key long, neighbour long, distance double")
        found = found.groupBy("key").agg(F.collect_list(F.struct("distance", "neighbour")).alias("found"))
        best = F.slice(F.array_sort(F.concat("best", F.coalesce("found", F.array().cast("array<struct<distance: double, neighbour: long>>")))), 1, k)
        merged = asked.join(found, "key", "left").select("key", "vec", best.alias("best"), F.concat("visited", "leaves").alias("visited"), "leaves")
        state, take = merged.mapInArrow(_next_leaves(tree_ref, k, take), STATE), take * GROWTH
    done.append(_by_blocks(reduce(DataFrame.unionByName, wide), ref, n, tree.centres().shape[1], k, exclude_self, counted))
    rows = reduce(DataFrame.unionByName, done).select("key", F.posexplode("best").alias("place", "b"))
    return rows.select("key", "b.neighbour", (F.col("place") + 1).cast("int").alias("rank"), "b.distance")
