"""Difference-cover suffix ranking (modulo 3) of one text, in numpy.

Positions 1 and 2 modulo 3 are named by their sorted symbol triples; where names
repeat, the string of names is ranked by recursion; the remaining suffixes are
sorted by (symbol, rank of the next suffix) and merged by counting.
Recursion ends once names stand for ``depth`` symbols: suffixes that agree that far may tie.
"""

from __future__ import annotations

import numpy as np


def suffix_ranks(text: np.ndarray, depth: int, span: int = 1) -> np.ndarray:
    """Number of smaller suffixes of each position; the symbols are positive integers.
    Suffixes of one rank agree in ``depth`` symbols at least (``span`` symbols of the caller each)."""
    n = len(text)
    bits = int(text.max()).bit_length() if n else 1
    if 3 * bits > 63:  # names instead of symbols, so that three fit into a word
        text = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
        bits = int(text.max()).bit_length()
    t = np.zeros(n + 4, np.int64)
    t[:n] = text
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    triples = (((t[sample] << bits) | t[sample + 1]) << bits) | t[sample + 2]
    names = _names(triples)
    if len(names) and names.max() < len(names) and 3 * span < depth:
        names = suffix_ranks(names, depth, 3 * span) + 1

    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    real = sample < n  # without the empty suffix that closes the first half of the names
    ones, names = ones[ones < n], names[real]
    low = max(int(names.max()).bit_length() if len(names) else 1, 1)
    zeros = np.arange(0, n, 3)
    # comparable with suffixes 1 (symbol, rank of the next) and 2 (two symbols, rank after them)
    by_one = lambda at: (t[at] << low) | rank[at + 1]
    by_two = lambda at: (((t[at] << bits) | t[at + 1]) << low) | rank[at + 2]
    zero_one, zero_two = by_one(zeros), by_two(zeros)
    one, two = by_one(ones), by_two(twos)
    sorted_zero, sorted_zero_two = np.sort(zero_one), np.sort(zero_two)
    out = np.empty(n, np.int64)
    out[zeros] = _below(sorted_zero, zero_one) + _below(np.sort(one), zero_one) + _below(np.sort(two), zero_two)
    in_sample = _below(np.sort(names), names)
    out[ones] = in_sample[: len(ones)] + _below(sorted_zero, one)
    out[twos] = in_sample[len(ones) :] + _below(sorted_zero_two, two)
    return out


def _names(keys: np.ndarray) -> np.ndarray:
    """Dense names from 1 in the order of the keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    step = np.ones(len(keys), np.int64)
    step[1:] = ordered[1:] != ordered[:-1]
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(step)
    return names


def _below(ordered: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.searchsorted(ordered, keys, side="left")
