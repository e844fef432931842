"""Line dedup against brute force, on both the broadcast and the join path."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dialsift.llm.line_dedup import line_dedup, twice_seen

from .conftest import AWKWARD

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows, least, first=False):
    seen = Counter()
    where = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        seen.update({key(x) for x in lines} - {""})
        for n, x in enumerate(lines):
            at = (i is None, i or 0, n)
            where[key(x)] = min(where.get(key(x), at), at)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for n, x in enumerate(lines) if key(x) == "" or seen[key(x)] < max(2, least) or (first and where[key(x)] == (i is None, i or 0, n))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def corpus():
    rnd = random.Random(1)
    common = ["Common Line", " common line\t", "footer", "A b c", "", "  ", "ÀÉ x"]
    rows = [(k, "\n".join(rnd.choice(common) if rnd.random() < 0.4 else f"own {k} {n}" for n in range(rnd.randint(0, 9)))) for k in range(150)]
    return rows + [(k + 1000, "hot\nhot\ntext") for k in range(80)]


@pytest.mark.parametrize("broadcast", [16 << 20, 0])
@pytest.mark.parametrize("first", [False, True])
def test_equals_brute_force(written, broadcast, first):
    rows = corpus()
    out = line_dedup(written(rows), 10, first, broadcast_bytes=broadcast)
    got = Counter((r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in out.select("doc_id", "text", "line_dedup.*").collect())
    assert got == brute(rows, 10, first)


def test_a_full_filter_changes_nothing(written):
    """A filter far too small lets every key through to the exact confirmation."""
    rows = corpus()
    out = line_dedup(written(rows), 10, max_bits=1 << 20)
    assert out.agg(F.sum("line_dedup.n_dropped")).first()[0] == sum(n * r[3] for r, n in brute(rows, 10).items())
    assert twice_seen(written(rows).select("text"), 1 << 30)[0] >= 1 << 20


def test_awkward_rows(written):
    out = line_dedup(written(AWKWARD), 2)
    got = Counter((r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in out.select("doc_id", "text", "line_dedup.*").collect())
    assert got == brute(AWKWARD, 2)


def test_empty_table_and_clashing_columns(spark, written):
    assert line_dedup(written([], parts=1)).count() == 0
    rows = written([(1, "a\nb", 5, "key"), (2, "a\nc", 6, "n")], "doc_id long, text string, line_dedup int, key string")
    got = line_dedup(rows, 2).orderBy("doc_id").collect()
    assert [(r["text"], r["key"], r["line_dedup"]["n_dropped"]) for r in got] == [("b", "key", 1), ("c", "n", 1)]
