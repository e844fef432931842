"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dialsift.llm import spelling
from dialsift.llm.catalog import op13_spelling
from dialsift.llm.spelling import count_words, group_variants, letters, near_words, one_edit, search

from .conftest import AWKWARD


def edits(word, alphabet):
    """Every string that one edit makes of ``word``."""
    cut = {word[:k] + word[k + 1 :] for k in range(len(word))}
    put = {word[:k] + c + word[k:] for k in range(len(word) + 1) for c in alphabet}
    swap = {word[:k] + c + word[k + 1 :] for k in range(len(word)) for c in alphabet}
    return (cut | put | swap) - {word}


def brute_words(rows, drop=97, min_chars=5, min_count=3):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if drop and h % drop == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= min_chars and n >= min_count}


def brute_groups(words, ratio=2):
    alphabet = set("".join(words))
    form, out = {}, {}
    for w, n in words.items():
        near = [x for x in edits(w, alphabet) if x in words]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = (form[w], n, len(near), words[form[w]] if form[w] is not None else None)
    rows = []
    for w, (f, n, k, m) in out.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, f, root, n, k, m))
    return sorted(rows)


def vocabulary(seed=1, n=900):
    rnd = random.Random(seed)
    roots = ["".join(rnd.choice("aabcdeeéñ") for _ in range(rnd.randint(5, 9))) for _ in range(n // 6)]
    words = {}
    for w in roots:
        words[w] = rnd.choice([3, 50, 400])
        for _ in range(4):
            words.setdefault(rnd.choice(sorted(edits(w, "abcdeéñ"))), rnd.choice([3, 4, 9, 30, 200]))
        words.setdefault("".join(rnd.sample(w, len(w))), 5)
    return words


def table(spark, words):
    return spark.createDataFrame(sorted(words.items()), "word string, n long").repartition(5)


@pytest.mark.parametrize(("cell_rows", "sample", "leaf"), [(8192, 50_000, 48), (20, 400, 4), (5, 30, 1)])
def test_equals_brute_force(spark, monkeypatch, cell_rows, sample, leaf):
    """One cell a length, and trees of many cells chosen from small samples."""
    monkeypatch.setattr(spelling, "LEAF", leaf)
    words = vocabulary()
    got = sorted(tuple(r) for r in group_variants(table(spark, words), cell_rows=cell_rows, sample=sample).collect())
    assert got == brute_groups(words)
    assert any(r[2] not in (r[0], r[1]) for r in got)  # a chain of two forms


def test_anagrams_are_split_by_prefixes():
    """720 words of equal counts: the candidates that are verified are at most half of all pairs."""
    words = sorted("".join(p) for p in permutations("abcdef"))
    points, queries = letters(words, 6), letters([w[:3] + w[4:] for w in words], 5)
    seen, plain = [], spelling.one_edit

    def counting(a, b):
        seen.append(len(a))
        return plain(a, b)

    spelling.one_edit = counting
    try:
        found = {(words[p], q) for a, b in search(points, queries) for q, p in zip(a.tolist(), b.tolist(), strict=True)}
    finally:
        spelling.one_edit = plain
    short = [w[:3] + w[4:] for w in words]
    assert found == {(w, q) for q, s in enumerate(short) for w in edits(s, "abcdef") & set(words)}
    assert sum(seen) <= 0.5 * 720 * 720
    assert not sum(len(a) for a, _ in search(points, points))  # a swap is two edits


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abà", min_size=3, max_size=5), min_size=2, max_size=40, unique=True))
def test_search_finds_every_pair(words):
    for k in (3, 4, 5):
        for up in (0, 1):
            p, q = [w for w in words if len(w) == k + up], [w for w in words if len(w) == k]
            if p and q:
                found = sorted((q[a], p[b]) for x, y in search(letters(p, k + up), letters(q, k)) for a, b in zip(x.tolist(), y.tolist(), strict=True))
                assert found == sorted((x, y) for x in q for y in p if y in edits(x, "abà"))


def test_one_edit():
    a, b = letters(["abcd", "abcd", "abcd"], 4), letters(["abxcd", "xabcd", "abdcx"], 5)
    assert one_edit(a, b).tolist() == [True, True, False]
    assert one_edit(a, letters(["abcd", "abce", "bacd"], 4)).tolist() == [False, True, False]


def test_unary_counts_of_any_letters():
    """Many repeats and letters that share a column never take near words out of reach."""
    rnd = random.Random(4)
    words = ["".join(rnd.choice("aaaaaéèêzЖ漢") for _ in range(9)) for _ in range(60)]
    words += [rnd.choice(sorted(x for x in edits(w, "aéèêzЖ漢") if len(x) == 9)) for w in words]
    words = sorted(set(words))
    got = {(words[a], words[b]) for x, y in search(letters(words, 9), letters(words, 9)) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert got == {(a, b) for a in words for b in words if sum(x != y for x, y in zip(a, b, strict=True)) == 1}


def test_query(spark, written, tmp_path):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abdeinorst") for _ in range(rnd.randint(3, 8))) for _ in range(150)] + ["Élan", "naïve", "über", "STRASSE"]
    rows = AWKWARD + [(k, " ".join(rnd.choice(base[:40] if rnd.random() < 0.7 else base) + rnd.choice(["", "x", ",", "-"]) for _ in range(120))) for k in range(100, 220)]
    written(rows).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_groups(brute_words(rows))
    got = sorted(tuple(r) for r in op13_spelling(spark, str(tmp_path)).collect())
    assert got == want and any(r[1] for r in got)


def test_counts_and_long_texts(written, monkeypatch):
    rows = [(1, "Alpha alpha ALPHA; beta"), (1, "alpha"), (None, "gamma " * 4), (2, None), (3, "")]
    assert {tuple(r) for r in count_words(written(rows)).collect()} == {("alpha", 4), ("gamma", 4)}
    monkeypatch.setattr(spelling, "LONG", 3)
    assert brute_words(AWKWARD, drop=3, min_chars=2, min_count=1) == dict(
        tuple(r) for r in count_words(written(AWKWARD), min_chars=2, min_count=1, drop_one_in=3).collect())


def test_empty_tables_nulls_repeats_and_other_columns(spark, written):
    assert count_words(written([], parts=1)).count() == 0
    assert group_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    rows = [(None, 5, "x"), ("house", 4, "a"), ("house", 6, "b"), ("hause", 5, None), ("mouse", 10, ""), ("", 1, ""), ("a", 2, "")]
    got = sorted(tuple(r) for r in group_variants(spark.createDataFrame(rows, "word string, n long, form string")).collect())
    assert got == [("", "a", "a", 1, 1, 2), ("a", None, "a", 2, 1, None), ("hause", "house", "house", 5, 1, 10),
                   ("house", None, "house", 10, 2, None), ("mouse", None, "mouse", 10, 1, None)]
    assert near_words(spark.createDataFrame([("abcde", 3)], "word string, n long")).count() == 0


def test_upper_tree_deals_every_word_to_one_cell():
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(500)})
    codes = spelling.unary(letters(words, 6))
    tree = spelling.UpperTree(codes[::5], len(words), 40)
    own = np.concatenate([rows for rows, _ in tree.reached(codes, 0, 0)])
    assert tree.cells > 5 and sorted(own.tolist()) == list(range(len(words)))
