"""Fingerprints: next row, edits, likeness near Jaccard; near duplicates against brute force."""

import hashlib
import random

from dialsift.llm import catalog, minhash
from dialsift.llm.minhash import edited, fingerprint_documents, near_duplicates

from .conftest import AWKWARD


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus(n=200):
    rnd = random.Random(6)
    return [(k * 37 % 1000, " ".join(f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(0, 200)))) for k in range(n)]


def check_order(df, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    expected = []
    for k, (i, t) in enumerate(order):
        t, u = t or "", order[(k + 1) % len(order)][1] or ""
        expected.append((i, len(t), hashlib.sha256(edited(t, u).encode()).hexdigest(), t, u))
    got = fingerprint_documents(df).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == sorted((e[:3] for e in expected), key=str)
    return got, expected


def test_next_row_and_likeness(spark, written):
    rows = corpus()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("8", "1", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got, expected = check_order(written(rows), rows)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    by_id = {e[0]: e for e in expected}
    errors = []
    for r in got:
        _, _, _, t, u = by_id[r["doc_id"]]
        errors.append(abs(r["near_edited"] - jaccard(t, edited(t, u))))
        assert abs(r["near_next"] - jaccard(t, u)) < 0.25
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.05


def test_equal_texts_have_equal_fingerprints_and_awkward_rows(written):
    got, _ = check_order(written(AWKWARD), AWKWARD)
    same = {r["fingerprint"] for r in got if r["n_chars"] == len("same text here for you")}
    assert len(same) == 1
    assert all(len(r["fingerprint"]) == 8 * minhash.PERMUTATIONS and 0 <= r["near_edited"] <= 1 for r in got)


def test_small_tables(written):
    assert fingerprint_documents(written([], parts=1)).count() == 0
    only = fingerprint_documents(written([(5, "a b c d e f")])).collect()
    assert [(r["doc_id"], r["near_next"]) for r in only] == [(5, 1.0)]
    extra = written([(1, "a", 1, True), (2, "b", 2, False)], "doc_id long, text string, id int, borrowed boolean")
    assert fingerprint_documents(extra).count() == 2


def brute(rows):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] or "") == (rows[b][1] or "") or (shingles(rows[a][1]) and jaccard(rows[a][1], rows[b][1]) >= 0.8):
                root[find(a)] = find(b)
    low = {}
    for k, (i, t) in enumerate(rows):
        key = "none" if not shingles(t) else find(k)  # texts without words are alike
        if i is not None:
            low[key] = min(low.get(key, i), i)
    return sorted(((i, low.get("none" if not shingles(t) else find(k))) for k, (i, t) in enumerate(rows)), key=str)


def test_near_duplicates(written):
    rnd = random.Random(2)
    rows = corpus(60)
    for base in range(3):
        words = [f"v{rnd.randrange(2000)}" for _ in range(150)]
        for _ in range(40):
            own = list(words)
            for _ in range(rnd.randint(0, 6)):
                own[rnd.randrange(len(own))] = f"y{rnd.randrange(99)}"
            rows.append((5000 + len(rows), " ".join(own)))
    rows += AWKWARD
    got = sorted(((r["doc_id"], r["class_id"]) for r in near_duplicates(written(rows)).collect()), key=str)
    assert got == brute(rows)
    assert near_duplicates(written([], parts=1)).count() == 0


def test_rounds_of_a_bucket(spark, monkeypatch):
    """A bucket whose smallest text is like no other: the rest is verified among itself, few texts in pairs."""
    sets = {0: range(900, 1000)} | {k: range(k, k + 100) for k in range(1, 40)} | {100 + k: range(5000 + 1000 * k, 5100 + 1000 * k) for k in range(20)}
    jac = lambda a, b: len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]})
    rows = spark.createDataFrame([(k, list(v)) for k, v in sets.items()], "rep long, shingles array<long>")
    buckets = spark.createDataFrame([(7, k) for k in sets], "key long, rep long")

    def classes(links):
        root = {k: k for k in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        groups = {}
        for k in sets:
            groups.setdefault(find(k), set()).add(k)
        return sorted(map(sorted, groups.values()))

    expected = classes([(a, b) for a in sets for b in sets if a < b and jac(a, b) >= 0.8])
    assert [len(g) for g in expected].count(1) == 21 and max(map(len, expected)) == 39
    for few in (0, 3, 64):
        monkeypatch.setattr(minhash, "FEW", few)
        assert classes([(r["a"], r["b"]) for r in minhash._links(buckets, rows, 0.8).collect()]) == expected


def test_fingerprints_with_classes(written):
    """The verified class of every row beside its fingerprint; no expression grows with the rows."""
    rnd = random.Random(4)
    words = [f"v{rnd.randrange(2000)}" for _ in range(120)]
    rows = corpus(40) + AWKWARD + [(2000 + k, " ".join(words[:50] + [f"u{k % 7}"] + words[51:])) for k in range(30)]
    out = fingerprint_documents(written(rows), with_classes=True)
    assert sorted(((r["doc_id"], r["class_id"]) for r in out.collect()), key=str) == brute(rows)
    many = written([(k * 10, f"text {k}") for k in range(3000)])
    size = lambda n: len(minhash.neighbours_in_order(many, rows_per_slice=n)._jdf.queryExecution().analyzed().toString())
    assert size(10) < 1.2 * size(3000)


def test_query_returns_the_verified_classes(spark, written, tmp_path):
    rnd = random.Random(8)
    words = [f"v{rnd.randrange(2000)}" for _ in range(120)]
    rows = corpus(40) + [(2000 + k, " ".join(words[:50] + [f"u{k % 7}"] + words[51:])) for k in range(30)]
    written(rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = catalog.op5_minhash(spark, str(tmp_path))
    assert out.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(((r["doc_id"], r["class_id"]) for r in out.collect()), key=str) == brute(rows)


def test_buckets_of_one_class_need_one_pair_a_text(spark, monkeypatch):
    """Near copies that share many bands, with another smallest text in each, are verified once a text."""
    asked, plain = [], minhash._distances
    monkeypatch.setattr(minhash, "_distances", lambda pairs, sets: asked.append(pairs.count()) or plain(pairs, sets))
    rows = spark.createDataFrame([(k, list(range(100)) + [1000 + k]) for k in range(60)], "rep long, shingles array<long>")
    buckets = spark.createDataFrame([(key, k) for key in range(20) for k in range(60) if k >= key], "key long, rep long")
    links = minhash._links(buckets, rows, 0.8).collect()
    assert {x for r in links for x in r} == set(range(60)) and sum(asked) <= 60


def test_a_wide_cloud_is_sifted_by_sketches(spark, monkeypatch):
    """Texts of one bucket that are all alike at 0.6 need no pair verified, and no round for each of them; a pair that is near is found."""
    asked, plain = [], minhash._distances
    monkeypatch.setattr(minhash, "_distances", lambda pairs, sets: asked.append(pairs.count()) or plain(pairs, sets))
    sets = {k: [*range(120), *range(1000 + 40 * k, 1040 + 40 * k)] for k in range(100)}
    sets[100] = sets[50][:-4]  # of the cloud, near one text that is not the smallest
    rows = spark.createDataFrame(list(sets.items()), "rep long, shingles array<long>")
    buckets = spark.createDataFrame([(7, k) for k in sets], "key long, rep long")
    assert [(r["a"], r["b"]) for r in minhash._links(buckets, rows, 0.8).collect()] == [(50, 100)]
    assert sum(asked) <= 3 and len(asked) == 3


def test_sketches_leave_out_no_near_pair():
    rnd = random.Random(3)
    sets = []
    for size in (0, 0, 1, 1, 4, 5, 60, 64, 65, 70, 500, 520, 3000):
        base = rnd.sample(range(1 << 40), size)
        sets += [base] + [base[: size - cut] + rnd.sample(range(1 << 41, 1 << 42), new) for cut in (0, size // 12, size // 4) for new in (0, size // 9, size // 5)]
    sets = [minhash.np.unique(minhash.np.array(s, minhash.np.int64)) for s in sets]
    n, bits = minhash.np.array([len(s) for s in sets]), [minhash.sketch(s) for s in sets]
    u, v, _ = minhash.near_by_sketch(n, bits, minhash.most_apart(0.8), lambda u, o: o >= 0)
    found = {(min(p), max(p)) for p in zip(u.tolist(), v.tolist(), strict=True)}
    far = {(a, b): minhash.jaccard_distance(sets[a], sets[b]) for a in range(len(sets)) for b in range(a + 1, len(sets))}
    assert {p for p, d in far.items() if d <= 0.2 + 1e-9} <= found
    assert all(far[p] < 0.35 for p in found)


def test_forest_connects_what_the_edges_connect():
    array = minhash.np.array
    u, v, weight = array([0, 1, 0, 3, 2]), array([1, 2, 2, 4, 0]), array([0.1, 0.2, 0.05, 0.3, 0.0])
    assert sorted(minhash.forest(u, v, weight, array([10, 11, 12, 13, 14]))) == [0, 3, 4]
    assert sorted(minhash.forest(u, v, weight, array([10, 11, 10, 13, 13]))) == [0]
