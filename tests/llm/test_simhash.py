"""SimHash classes against brute force."""

import random

import pytest
import xxhash

from dialsift.llm import simhash
from dialsift.llm.components import components

from .conftest import AWKWARD

WHITE = " \t\n\x0b\x0c\r"


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for w in WHITE[1:]:
        low = low.replace(w, " ")
    words = [w for w in low.split(" ") if w]
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, prints):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for k, i in enumerate(ids):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [low.get(find(k)) for k in range(len(ids))]


def check(df, rows, **kw):
    prints = [fingerprint(t) for _, t in rows]
    expected = sorted(zip([i for i, _ in rows], prints, classes([i for i, _ in rows], prints), strict=True), key=str)
    got = simhash.simhash_classes(df, **kw).collect()
    assert sorted(((r[0], r[1] & (1 << 64) - 1, r[2]) for r in got), key=str) == expected


@pytest.mark.parametrize("hot", [64, 3])
def test_near_copies(written, hot):
    rnd = random.Random(3)
    rows = []
    for base in range(6):
        words = [f"w{rnd.randrange(500)}" for _ in range(rnd.randint(40, 160))]
        for _ in range(40):
            own = list(words)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = f"x{rnd.randrange(9)}"
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
    check(written(rows), rows, hot_bucket=hot)


def test_awkward_rows(written):
    check(written(AWKWARD), AWKWARD)


def test_long_chain_of_links(spark):
    """Fingerprints two bits apart in a row are one class, also through hot keys."""
    prints = [0]
    for k in range(0, 40, 2):
        prints.append(prints[-1] | 3 << k)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for hot in (64, 2):
        forest = components(simhash.links(df, hot)).collect()
        assert len(forest) == len(prints) and {r["root"] for r in forest} == {0}


def test_empty_table_and_extra_columns(written):
    assert simhash.simhash_classes(written([], parts=1)).count() == 0
    rows = written([(1, "a b c d", 9, 9), (2, "a b c d", 8, 8)], "doc_id long, text string, fp long, component_id long")
    assert {r["component_id"] for r in simhash.simhash_classes(rows).collect()} == {1}
