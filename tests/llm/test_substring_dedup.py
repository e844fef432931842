"""Substring dedup and suffix ranks against brute force."""

import random

import numpy as np
import pytest

from dialsift.llm import substring_dedup as module
from dialsift.llm.substring_dedup import LENGTH, substring_dedup
from dialsift.llm.suffix_ranks import suffix_ranks

from .conftest import AWKWARD


def test_suffix_ranks():
    rnd, gen = random.Random(0), np.random.default_rng(0)
    for _ in range(200):
        n = rnd.randint(0, 60)
        text = gen.integers(1, rnd.choice([2, 3, 5, 200]), n)
        s = text.tolist()
        assert suffix_ranks(text, 10**9).tolist() == [sum(s[j:] < s[i:] for j in range(n)) for i in range(n)]
        for depth in (4, 10):
            rank = suffix_ranks(text, depth)
            prefixes = [tuple(s[i : i + depth]) for i in sorted(range(n), key=lambda i: rank[i])]
            assert prefixes == sorted(prefixes)


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - LENGTH + 1):
            w = b[k : k + LENGTH]
            if w in seen:
                cover[k : k + LENGTH] = b"\1" * LENGTH
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if cover[k] and (k == 0 or not cover[k - 1]))
        out.setdefault(i, []).append((len(b), sum(cover), spans, bytes(x for x, c in zip(b, cover, strict=True) if not c)))
    return {i: sorted(v) for i, v in out.items()}


def run(df, **kw):
    out = {}
    for r in substring_dedup(df, out_col="c", **kw).collect():
        out.setdefault(r["doc_id"], []).append((r["c"]["n_bytes"], r["c"]["n_removed"], r["c"]["n_spans"], bytes(r["c"]["kept"])))
    return {i: sorted(v) for i, v in out.items()}


def corpus():
    rnd = random.Random(4)
    syllables = ["ab", "cde", "fg", "é", "hi ", "j ", "klm ", "\n"]
    some = lambda n: "".join(rnd.choice(syllables) for _ in range(n))
    passages = [some(rnd.randint(20, 120)) for _ in range(12)]
    rows = []
    for k in range(200):
        text = ""
        for _ in range(rnd.randint(0, 6)):
            p = rnd.choice(passages)
            text += some(rnd.randint(0, 40)) + (p[rnd.randint(0, len(p)) :] if rnd.random() < 0.3 else p)
        rows.append((k * 3 % 307, text))
    return rows + [(1000, "x" * 99), (1001, "x" * 100), (1002, "x" * 350), (1003, "ab" * 300), (1004, passages[0] * 5), (1005, passages[0] * 5)]


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 3000, "hot_snippets": 5, "piece_bytes": 300}, {"chunk_bytes": 1500}, {"piece_bytes": 101},
                                   {"max_filter_bits": 1 << 20, "hot_snippets": 20}])
def test_equals_brute_force(written, sizes):
    rows = corpus()
    assert run(written(rows), **sizes) == brute(rows)


def test_awkward_rows(written):
    rows = [r for r in AWKWARD if r[0] != 11] + [(20, "é" * 400), (21, "é" * 400)]
    assert run(written(rows)) == brute(rows)


def test_repeated_rows_lose_all_but_one(written):
    text = " ".join(str(k) for k in range(100))
    got = run(written([(7, text), (7, text), (7, text), (None, text)]))
    assert sorted(x[1] for x in got[7]) == [0, len(text), len(text)] and got[None][0][1] == len(text)


def test_empty_table_and_clashing_columns(written):
    assert substring_dedup(written([], parts=1)).count() == 0
    df = written([(1, "q" * 150, 1, 2)], "doc_id long, text string, row int, begin int")
    row = substring_dedup(df, out_col="c").first()
    assert (row["row"], row["begin"], row["c"]["n_removed"]) == (1, 2, 149)


def test_files_packed_anew_between_the_reads(written, repacked):
    rows = corpus()
    docs = written(rows, parts=5)
    repacked(module)
    assert run(docs) == brute(rows)


@pytest.mark.parametrize("share", [10**9, 300])
def test_common_minimisers_are_dealt_by_context(written, monkeypatch, share):
    """All minimisers, or the commonest, taken as wide: the result is the same."""
    monkeypatch.setattr(module, "WIDE_LEAST", 1)
    monkeypatch.setattr(module, "WIDE_SHARE", share)
    rows = corpus()
    assert run(written(rows)) == brute(rows)
    assert run(written(rows), sample_docs=20, hot_least=5) == brute(rows)


def test_a_string_of_many_documents_is_not_one_tasks(spark, written):
    """A string of 110 bytes in every document, each time in other surroundings: no key holds its places."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    common = " ".join(word() for _ in range(14))[:110]
    rows = [(k, " ".join(word() for _ in range(20)) + common + " ".join(word() for _ in range(20))) for k in range(3000)]
    docs = written(rows).selectExpr("doc_id AS doc", "doc_id AS row", "text")
    wide = module._wide_seeds(docs, 4 << 20, 1000)
    count = lambda w: docs.mapInArrow(module._emit_places(4 << 20, w), module.PLACES).groupBy("key").count().agg({"count": "max"}).first()[0]
    assert len(wide) and count(np.zeros(0, np.int64)) >= 1000 and count(wide) < 100
