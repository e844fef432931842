"""Token counts and the BPE codec equal the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dialsift.llm import bpe, bpe_codec
from dialsift.llm.bpe_codec import Encoder, decode, encode
from dialsift.llm.token_counts import count_tokens
from dialsift.llm.transducer import Transducer, compile_words

from .conftest import AWKWARD

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    alphabet = [*"ab c'stremdvl \n\t\r\x0b\x1c\x1d\x85\xa0　é²½Ⅷ漢字1٣!?<|>😀́ñß'", "<|endoftext|>", "'re", "'ll", "  ", "\n\n", "՘", "\U00011DDA"]
    out = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 60))) for _ in range(1500)]
    return [*out, "a" * 3000, " " * 700, "ab" * 2000, "漢" * 300, "The quick brown fox, it's 42!"]


def test_encoder_equals_library(library, texts, tmp_path):
    model = bpe.Bpe(open(PATH, "rb").read())
    words = list(dict.fromkeys(w for t in texts[:300] for w in model.words(t) if isinstance(w, str)))
    for lexicon in ([], words[::2], words):
        path = tmp_path / f"lexicon-{len(lexicon)}"
        path.write_bytes(compile_words([(w.encode(), model.merge(w)) for w in lexicon]))
        offsets, ids = Encoder(model, Transducer(str(path))).encode(texts)
        expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == expected


def test_transducer_shares_suffixes(tmp_path):
    words = [f"{a}{b}ing".encode() for a in "abcdefgh" for b in "klmnop"]
    path = tmp_path / "t"
    path.write_bytes(compile_words([(w, [k, k + 1]) for k, w in enumerate(words)]))
    t = Transducer(str(path))
    assert len(t.final) == 6  # start, after one and two letters, i, n, g: every word has the same suffixes
    ranks = t.ranks([*words, b"akin", b"akingx", b"", b"zking"])
    order = sorted(range(len(words)), key=lambda k: words[k])
    assert [order[r] for r in ranks[: len(words)]] == list(range(len(words))) and (ranks[len(words) :] == -1).all()
    assert t.output(int(ranks[5])).tolist() == [5, 6]


def test_codec(written, library, texts):
    rows = [(k, t) for k, t in enumerate(texts)] + [(i, t) for i, t in AWKWARD]
    out = decode(encode(written(rows), lexicon_words=50)).select("doc_id", "text", "ids", "decoded").collect()
    assert len(out) == len(rows)
    for r in out:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False) == (r["text"] or "")


def test_lexicon_counts_every_document(spark, monkeypatch):
    docs = spark.range(30_000).select(F.concat(F.lit("common"), F.when(F.col("id") % 3 == 0, " rare").otherwise("")).alias("text"))
    counts, plain = {}, bpe_codec.materialise

    def keep(df, name):
        out = plain(df, name)
        counts.update({r["word"]: r["n"] for r in out.collect()})
        return out

    monkeypatch.setattr(bpe_codec, "materialise", keep)
    bpe_codec.build_lexicon(docs, bpe.read_vocabulary(spark, None), 10)
    assert counts == {"common": 30_000, " rare": 10_000}


def test_decode_of_odd_ids(spark, library):
    rows = spark.createDataFrame([(1, [50256, 0, 99999999, -1]), (2, None), (3, []), (4, [None, 0]), (5, [162])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in decode(rows).collect()}
    assert got == {1: "<|endoftext|>!", 2: "", 3: "", 4: "!", 5: "�"}


@pytest.mark.parametrize("frequent", [200_000, 20, 0])
def test_counts(written, library, texts, frequent):
    rows = [(k, t) for k, t in enumerate(texts)] + AWKWARD
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in count_tokens(written(rows), frequent_words=frequent).collect()), key=str)
    expected = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert got == sorted(expected, key=str)


def test_empty_tables_and_clashing_columns(written):
    assert count_tokens(written([], parts=1)).count() == 0 and decode(encode(written([], parts=1))).count() == 0
    df = written([(1, "hello world", 3, "w", 1)], "doc_id long, text string, ids int, word string, row int")
    assert count_tokens(df).collect()[0]["n_tokens"] == 2
    row = encode(df).withColumn("h", F.array_join(F.col("ids").cast("array<string>"), ",")).collect()[0]
    assert row["h"] == "31373,995" and row["word"] == "w" and hashlib.sha256(row["h"].encode()).hexdigest()
