"""Fill-in-middle against a plain version in code points."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from dialsift.llm.catalog import op11_fim
from dialsift.llm.fill_in_middle import ExceptionIndex, Marks, Sentinels, fill_in_middle, restore
from pyspark.sql import functions as F

from .conftest import AWKWARD


def brute(i, text, unit="token", rate=90, spm=20, seed=1, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if unit == "token":
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    elif unit == "char":
        units = list(text)
    else:
        units = [None] * len(text.encode())
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if unit == "byte":
        raw = text.encode()
        while a < len(raw) and raw[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        parts = [raw[:a].decode(), raw[a:b].decode(), raw[b:].decode()]
    else:
        parts = ["".join(units[:a]), "".join(units[a:b]), "".join(units[b:])]
    p, s, m = marks
    if text == "" or any(x in text for x in marks) or h[2] % 100 >= rate:
        return i, n, "plain", None, None, text
    out = s + parts[2] + p + parts[0] + m + parts[1] if h[3] % 100 < spm else p + parts[0] + s + parts[2] + m + parts[1]
    return i, n, "spm" if h[3] % 100 < spm else "psm", len(parts[0]), len(parts[1]), out


def corpus(n=300):
    rnd = random.Random(3)
    alphabet = ["a", "Zb", " ", "\n", "é", "漢", "🙂", "-", "1", "word", "<P", "S>", "ß́"]
    return AWKWARD + [(100 + k, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))) for k in range(n)] + [
        (1000, "has <P> in it"), (1001, "x<M>"), (1002, "<S>"), (1003, "no <p> mark")]


@pytest.mark.parametrize("unit", ["token", "char", "byte"])
def test_equals_brute_force(written, unit):
    rows = corpus()
    out = fill_in_middle(written(rows), unit).select("doc_id", "text", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.col("fim.text").alias("out"))
    out = out.withColumn("again", restore(F.col("out"), F.col("form"))).collect()
    assert sorted((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["out"]) for r in out if r["doc_id"] is not None) == sorted(
        brute(i, t, unit) for i, t in rows if i is not None)
    assert all(r["again"] == (r["text"] or "") for r in out)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_parameters_and_own_sentinels(written):
    rows = corpus(120)
    marks = Sentinels("[p*]", "(s", "$m")
    out = fill_in_middle(written(rows), rate=50, spm=100, seed=9, sentinels=marks).select("doc_id", "text", "fim.form", F.col("fim.text").alias("out"))
    for r in out.withColumn("again", restore(F.col("out"), F.col("form"), marks)).collect():
        assert (r["form"], r["out"]) == brute(r["doc_id"], r["text"], rate=50, spm=100, seed=9, marks=marks.all())[2:6:3]
        assert r["again"] == (r["text"] or "")
    with pytest.raises(ValueError, match="unit"):
        fill_in_middle(written(rows), "line")


def test_empty_table_and_clashing_columns(written):
    assert fill_in_middle(written([], parts=1)).count() == 0
    rows = written([(7, "one two three", 5, "x", 2)], "doc_id long, text string, fim int, n string, cut1 int")
    got = fill_in_middle(rows, rate=100).collect()[0]
    assert (got["n"], got["cut1"], got["text"]) == ("x", 2, "one two three")
    assert tuple(got["fim"]) == brute(7, "one two three", rate=100)[1:]


def test_query(spark, written, tmp_path):
    rows = corpus(80)
    written(rows).write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    got = sorted(tuple(r) for r in op11_fim(spark, str(tmp_path)).collect() if r["doc_id"] is not None)
    assert got == sorted((i, n, f, p, m, sha(o), sha(t)) for (i, t) in rows if i is not None for _, n, f, p, m, o in [brute(i, t)])


@given(st.text(max_size=60))
def test_index_converts_every_offset(text):
    index = ExceptionIndex(np.frombuffer(text.encode(), np.uint8))
    codes = np.arange(len(text) + 1)
    at = np.array([len(text[:k].encode()) for k in codes])
    assert (index.to_bytes(codes) == at).all()
    assert (index.to_codes(at) == codes).all()
    every = np.arange(at[-1] + 1)
    assert (index.floor(every) == at[np.searchsorted(at, every, side="right") - 1]).all()
    assert len(index.byte_at) == sum(ord(c) > 127 for c in text)


@given(st.lists(st.booleans(), max_size=1500))
def test_marks_by_rank(bits):
    mask = np.array(bits, bool)
    marks, where = Marks(mask), np.flatnonzero(mask)
    assert (marks.place(np.arange(len(where))) == where).all()
    assert (marks.rank(np.arange(len(mask) + 1)) == np.concatenate(([0], np.cumsum(mask)))).all()
