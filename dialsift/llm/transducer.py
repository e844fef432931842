"""Minimal acyclic transducer over bytes.

Sorted words are added one after another; states with equal right language
are merged on the way, so suffixes are shared. Every edge carries how many
words sort before those it leads to: the edge sums along a word give its rank,
which addresses its output ids. The arrays lie one after another in a
file that workers map into memory.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterable, Sequence

import numpy as np

FIELDS = (("edge_key", np.int64), ("edge_to", np.int32), ("edge_skip", np.int32), ("final", np.uint8), ("id_start", np.int32), ("ids", np.int32))


_EDGE = struct.Struct("<BI")


def compile_words(entries: Iterable[tuple[bytes, Sequence[int]]]) -> bytes:
    """File image of the transducer of distinct words with their output ids."""
    states: dict[bytes, int] = {}  # packed (final, edges in order of their bytes), children before parents
    path: list[tuple[list[bool], list[bytes]]] = [([False], [])]  # of the last word: final, packed edges
    ids, id_start = array("i"), array("i", [0])
    last = b""

    def fold(depth: int) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            state = states.setdefault(bytes(final) + b"".join(edges), len(states))
            path[-1][1].append(_EDGE.pack(last[len(path) - 1], state))

    for word, output in sorted(entries, key=lambda e: e[0]):
        common, stop = 0, min(len(word), len(last))
        while common < stop and word[common] == last[common]:
            common += 1
        fold(common)
        path.extend(([False], []) for _ in range(len(word) - common))
        path[-1][0][0] = True
        last = word
        ids.extend(output)
        id_start.append(len(ids))
    fold(0)
    root = states.setdefault(bytes(path[0][0]) + b"".join(path[0][1]), len(states))

    keys, to, skip, below, finals = array("q"), array("i"), array("i"), array("i", bytes(4 * len(states))), bytearray()
    for packed, state in states.items():
        n = packed[0]
        finals.append(n)
        for byte, target in _EDGE.iter_unpack(packed[1:]):
            keys.append(state << 8 | byte)
            to.append(target)
            skip.append(n)
            n += below[target]
        below[state] = n
    arrays = {"edge_key": keys, "edge_to": to, "edge_skip": skip, "final": finals, "id_start": id_start, "ids": ids}
    parts = [np.frombuffer(arrays[name], kind) if len(arrays[name]) else np.empty(0, kind) for name, kind in FIELDS]
    depth = array("i", bytes(4 * len(states)))  # of the longest word below each state
    for key, target in zip(keys, to, strict=True):
        depth[key >> 8] = max(depth[key >> 8], depth[target] + 1)
    head = np.array([root, depth[root], *(len(p) for p in parts)], np.int64)
    return head.tobytes() + b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)


class Transducer:
    """A compiled file, mapped read-only."""

    def __init__(self, path: str) -> None:
        head = np.fromfile(path, np.int64, 2 + len(FIELDS))
        self.root, self.longest = int(head[0]), int(head[1])
        offset = head.nbytes
        for (name, kind), n in zip(FIELDS, head[2:].tolist(), strict=True):
            setattr(self, name, np.memmap(path, kind, "r", offset, (n,)) if n else np.empty(0, kind))
            offset += n * np.dtype(kind).itemsize
            offset += -offset % 8

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 for a word that is not in the lexicon. All words
        advance one byte at a time together."""
        lens = np.fromiter((len(w) for w in words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lens) - lens
        out = np.full(len(words), -1, np.int64)
        live = np.flatnonzero(lens <= self.longest)
        state, total = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64)
        for depth in range(self.longest + 1):
            done = lens[live] == depth
            ends = live[done]
            out[ends] = np.where(self.final[state[done]] == 1, total[done], -1) if len(self.final) else -1
            live, state, total = live[~done], state[~done], total[~done]
            if not len(live) or not len(self.edge_key):
                break
            key = (state << 8) | data[starts[live] + depth]
            at = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
            found = self.edge_key[at] == key
            live, at = live[found], at[found]
            state, total = self.edge_to[at].astype(np.int64), total[found] + self.edge_skip[at]
        return out

    def output(self, rank: int) -> np.ndarray:
        return self.ids[self.id_start[rank] : self.id_start[rank + 1]]
