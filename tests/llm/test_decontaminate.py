"""Greedy string tiling against a plain version; leaks found whole, reordered and among clean documents."""

import random
import time

from dialsift.llm.decontaminate import find_leaks, tile, tokens_text

from .conftest import AWKWARD


def plain_tiles(doc, item, least):
    """Greedy string tiling by trying every pair of places."""
    doc_marked, item_marked, out = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while (i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in doc_marked and j + n not in item_marked):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        doc_marked |= set(range(i, i + n))
        item_marked |= set(range(j, j + n))
        out.append((i, j, n))


def test_tiles_equal_the_plain_version():
    rnd = random.Random(5)
    for n in range(300):
        item = [rnd.randint(1, rnd.choice([2, 30])) for _ in range(rnd.randint(3, 30))]
        doc = []
        for _ in range(rnd.randint(0, 4)):
            a = rnd.randrange(len(item))
            doc += item[a : a + rnd.randint(1, 12)] + [0] * rnd.randint(0, 2)
        assert tile(doc, item, 1 + n % 4) == plain_tiles(doc, item, 1 + n % 4)


def test_tiles_of_repetitive_texts():
    """Two texts of one token, and of two tokens in turn: every pair of windows is equal."""
    began = time.time()
    assert tile([1] * 5000, [1] * 5000, 5) == [(0, 0, 5000)]
    assert tile([1] * 4999, [1] * 5000, 5) == [(0, 0, 4999)]
    assert tile([1, 2] * 2500, [2, 1] * 2500, 5)[0] == (0, 1, 4999)
    assert time.time() - began < 3
    tiles = tile([1] * 5000 + [0] + [1] * 300, [1] * 2000, 5)
    assert [n for *_, n in tiles] == [2000]


def passage(rnd, n):
    return [f"{rnd.choice('bcdfg')}{rnd.randrange(10_000)}" for _ in range(n)]


def leaks(df, bench, **kw):
    out = find_leaks(df, bench, **kw).collect()
    return {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in out}


def test_planted_leaks(spark, written):
    rnd = random.Random(7)
    items = [passage(rnd, rnd.randint(15, 60)) for _ in range(30)]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    rows, expected = [], {}
    for k in range(120):
        words = passage(rnd, rnd.randint(0, 200))
        item = rnd.randrange(30)
        x = items[item]
        kind = k % 4
        if kind == 1:
            words[len(words) // 2 : len(words) // 2] = [w.upper() + "," for w in x]
        elif kind == 2:  # halves swapped
            words += x[len(x) // 2 :] + ["gap"] + x[: len(x) // 2]
        elif kind == 3:  # a third only
            words += x[: len(x) // 3]
        rows.append((k, " ".join(words)))
        expected[k] = {item} if kind in (1, 2) else set()
    for block in (8 << 20, 2000):  # one block, and several
        assert leaks(written(rows), bench, block_bytes=block) == expected


def test_awkward_input(spark, written):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "same text here for you"), (4, "same text here for you"), (None, "word " * 40)],
                                  "item_id long, text string")
    got = find_leaks(written(AWKWARD), bench).collect()
    assert len(got) == len(AWKWARD)
    for r in got:
        expected = {"same text here for you": [4, 4], "one two": [3]}.get(r["text"], [None] if r["doc_id"] == 8 else [])
        assert [x["item_id"] for x in r["leaks"]] == expected
    assert find_leaks(written([], parts=1), bench).count() == 0
    assert all(not x for x in leaks(written([(1, "a b c d e f")]), bench.limit(0)).values())
    extra = written([(1, "same text here for you", "z")], "doc_id long, text string, leaks string")
    assert leaks(extra, bench) == {1: {4}}


def test_short_items(spark, written):
    """Items of fewer tokens than a seed are found where all their tokens stand in a row."""
    bench = spark.createDataFrame([(1, "zeta"), (2, "Alpha beta!"), (3, "one two three"), (4, "red green blue grey"), (5, "a b c d e f"), (6, "...")],
                                  "item_id long, text string")
    rows = [(1, "the ZETA function"), (2, "beta alpha"), (3, "x alpha, beta y alpha beta"), (4, "one two four three"), (5, "one two one two three"),
            (6, "red green blue grey"), (7, "red green blue"), (8, "a b c d e f zeta"), (9, "")]
    expected = {1: {1}, 2: set(), 3: {2}, 4: set(), 5: {3}, 6: {4}, 7: set(), 8: {5, 1}, 9: set()}
    for block in (8 << 20, 100):
        assert leaks(written(rows), bench, block_bytes=block) == expected
    found = {r["doc_id"]: r["leaks"] for r in find_leaks(written(rows), bench).collect()}
    assert [tuple(x) for x in found[3]] == [(2, 1.0, 2, 1, 2)]


def test_blocks_of_a_large_test_set(spark, written):
    """Several blocks find what one does, for repeated and null ids too, and keep the columns."""
    rnd = random.Random(3)
    items = [passage(rnd, rnd.randint(2, 40)) for _ in range(40)]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    rows = [(rnd.choice([None, 1, 2]), " ".join(passage(rnd, 9) + rnd.choice(items) + rnd.choice(items)), n) for n in range(60)]
    docs = written(rows, "doc_id long, text string, leaks long")
    one, many = (find_leaks(docs, bench, block_bytes=b, out_col="found") for b in (8 << 20, 1500))
    assert one.columns == many.columns == ["doc_id", "text", "leaks", "found"]
    as_rows = lambda df: {r["leaks"]: (r["doc_id"], r["text"], sorted(map(tuple, r["found"]))) for r in df.collect()}
    assert as_rows(one) == as_rows(many) and all(len(v[2]) for v in as_rows(one).values())


def test_tokens():
    assert tokens_text("Don't, STOP.\nÉa!").split() == [b"don", b"t", b"stop", "éa".encode()]
