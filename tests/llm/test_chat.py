"""Chat formatting: exact round trip, loss mask, turn order."""

import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from dialsift.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string"


@given(st.text(alphabet="<|\\im_startend>a\n"))
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def brute(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r[1:])
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: tuple((x is not None, x if x is not None else "") for x in t))
        turns = [(r or "", t or "") for _, r, t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        state, legal = "start", True
        for role, _ in turns:
            legal &= role in chat.CHATML.moves.get(state, {})
            state = role
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest(), legal and state == "assistant")
    return out


def read(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["legal_order"])
            for r in chat.read_back(chat.format_conversations(df)).collect()}


def test_round_trip(written):
    rnd = random.Random(2)
    pieces = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|", "a", "é🙂", "\n", " ", "<\\\\|im_end|>\n"]
    rows = [(c, t, rnd.choice(["system", "user", "assistant", "tool", "us\ner", None, "<|x"]), "".join(rnd.choices(pieces, k=rnd.randint(0, 6))) or None)
            for c in range(60) for t in range(rnd.randint(1, 7))]
    rows += [(500, k % 40, "user" if k % 2 else "assistant", f"t{k}") for k in range(1500)]  # one long conversation with tied turns
    rows += [(None, 0, "user", "q"), (None, None, "assistant", "a"), (501, 0, "user", "x" * 200_000), (501, 1, "assistant", "y" * 150_000)]
    rows += [(502, 0, "user", "same"), (502, 0, "user", "same")]
    assert read(written(rows, SCHEMA)) == brute(rows)


def test_segments_and_template(written):
    df = written([(1, 0, "user", "q<|im_end|>"), (1, 1, "assistant", "a")], SCHEMA, 1)
    text = "".join(r["text"] for r in chat.format_conversations(df).collect())
    assert text == "<|im_start|>user\nq<\\|im_end|><|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    own = chat.Template(opening="<|turn|>", close="<|stop|>", loss_roles=frozenset({"user"}), moves={"start": {"user": "user"}}, accepting=frozenset({"user"}))
    row = chat.read_back(chat.format_conversations(df, own), own).first()
    assert row["n_turns"] == 2 and row["loss_chars"] == len("q<|im_end|>") and not row["legal_order"]


def test_empty_table_and_extra_columns(written):
    assert chat.read_back(chat.format_conversations(written([], SCHEMA, 1))).count() == 0
    df = written([(1, 0, "user", "q", 1, "z")], SCHEMA + ", segment int, conv string")
    assert chat.format_conversations(df).count() == 4
