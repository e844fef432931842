"""Quality rules against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dialsift.llm import quality_rules as module
from dialsift.llm.catalog import op12_quality_rules
from dialsift.llm.quality_rules import Rules, quality_rules

from .conftest import AWKWARD

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, source string"


def words(text):
    return [w for w in re.split(f"[{WHITE}]+", text) if w]


def norm(line):
    return " ".join(words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)))


def brute(rows, rules=Rules()):
    """(id, counts, base_failed, n_lost_lines, kept, cleaned text) of each row."""
    per_line, hosts = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        hosts[host].add(text or "")
        for line in (text or "").split("\n"):
            if norm(line):
                per_line[host, norm(line)].add(text)
    bad = {k for k, v in per_line.items() if len(v) >= rules.line_docs and len(v) >= len(hosts[k[0]]) * rules.line_share}
    out = []
    for i, text, host in rows:
        w = words(text or "")
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        often = Counter(grams)
        covered = {p for k, g in enumerate(grams) if often[g] > 1 for p in range(k, k + 5)}
        lines = (text or "").split("\n")
        real = [x for x in lines if norm(x)]
        gone = [x for x in real if (host, norm(x)) in bad]
        failed = len(w) < rules.min_words or 100 * len(covered) > rules.max_repeat_percent * len(w)
        total = sum(len(norm(x)) for x in real)
        left = 1 - sum(len(norm(x)) for x in gone) / total if total else 1.0
        kept = "\n".join(x for x in lines if (host, norm(x)) not in bad) if text is not None else None
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(real) - len(set(real)), len(covered),
                    failed, len(gone), not failed and left >= rules.min_left, kept))
    return out


def result(out):
    return [tuple(r) for r in out.select("doc_id", *(f"rules.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost_lines", "kept")), "text").collect()]


def same(got, want):
    key = lambda t: tuple((x is None, str(x)) for x in t)
    assert sorted(got, key=key) == sorted(want, key=key)


def corpus(n=260):
    rnd = random.Random(5)
    common = ["Accept all  cookies", "accept ALL\tcookies ", "Sign in | Register", "© 2020 ÀÉ"]
    rows = []
    for k in range(n):
        own = [" ".join(f"w{rnd.randint(0, 40)}" for _ in range(rnd.randint(1, 25))) for _ in range(rnd.randint(0, 5))]
        lines = own + [rnd.choice(common) for _ in range(rnd.randint(0, 3))] + [" \t"] * rnd.randint(0, 2)
        rnd.shuffle(lines)
        rows.append((k, "\n".join(lines), f"src{rnd.choice([0, 0, 0, 1, 2])}"))
    rows += [(1000 + k, "the same page of many words that copies share\nfooter here", "src0") for k in range(40)]  # one distinct text
    rows += [(2000 + k, f"near copy of one page with many words in it\nown {k}", "src1") for k in range(30)]  # depleted
    return rows + [(3000, "a b c d e " * 50, "src2"), (3001, "one two three four five one two three four five six", None)]


@pytest.mark.parametrize("hot_share", [1000, 10])
def test_equals_brute_force(written, monkeypatch, hot_share):
    """With a share of 1/10 the commonest lines come back by broadcast, the others by shuffle."""
    monkeypatch.setattr(module, "HOT_SHARE", hot_share)
    rows = corpus()
    got = result(quality_rules(written(rows, SCHEMA)))
    same(got, brute(rows))
    by_id = {r[0]: r for r in got}
    assert not by_id[2000][8] and by_id[2000][7] == 1  # depleted
    assert by_id[1000][7] == 0  # exact copies do not make their own lines boilerplate
    assert 0 < sum(r[7] > 0 for r in got) < len(got)


def test_limits_and_other_columns(written):
    rows = corpus(100)
    rules = Rules(min_words=3, max_repeat_percent=50, line_docs=5, line_share=0.2, min_left=0.7)
    same(result(quality_rules(written(rows, SCHEMA), rules)), brute(rows, rules))
    named = written([(i, h, t, 1) for i, t, h in rows], "id long, site string, body string, rules int")
    out = quality_rules(named, rules, host_col="site", text_col="body", out_col="verdict")
    assert out.columns == ["id", "site", "body", "rules", "verdict"]
    assert out.filter("verdict.kept").count() == sum(r[8] for r in brute(rows, rules))


def test_awkward_rows(written):
    rows = [(i, t, h) for i, t in AWKWARD for h in ("a", None)] + [(50 + k, f"shared line of it\n{k}", None) for k in range(12)]
    same(result(quality_rules(written(rows, SCHEMA))), brute(rows))


def test_empty_table_and_clashing_columns(written):
    assert quality_rules(written([], SCHEMA, parts=1)).count() == 0
    rows = [(k, "x y z\n" + f"{k} " * 12, "s", k, "keep me", k) for k in range(10)]
    out = quality_rules(written(rows, SCHEMA + ", rules int, host string, row long"))
    assert out.columns == ["doc_id", "text", "source", "host", "row", "rules"]
    assert sorted((r["doc_id"], r["row"], r["host"], r["text"]) for r in out.collect()) == [(k, k, "keep me", f"{k} " * 12) for k in range(10)]


def test_rows_that_are_no_table(written):
    rows = corpus(60)
    same(result(quality_rules(written(rows, SCHEMA).filter("doc_id < 40 OR doc_id >= 2000"))), brute([r for r in rows if r[0] < 40 or r[0] >= 2000]))


def test_row_numbers_hold_when_files_are_packed_anew(written, repacked):
    rows = corpus(80)
    table = written(rows, SCHEMA)
    repacked(module)
    same(result(quality_rules(table)), brute(rows))


def test_query_is_native_and_does_not_shuffle_texts(spark, written, tmp_path):
    rows = corpus(60)
    written(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = op12_quality_rules(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert all("text" not in x for x in re.findall(r"ReadSchema: (\S+)", out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))))
    same([tuple(r) for r in out.collect()], [r[:7] + (r[8],) for r in brute(rows)])
    assert out.filter(F.col("kept")).count()
