"""Chat formatting by a finite-state machine over roles.

A declarative ``Template`` names the marks, the transitions between roles and
the roles that are trained on. ``format_conversations`` emits text segments in
order, each with its loss flag; joined by conversation they are the formatted
text. ``read_back`` parses them again. Marks inside texts and roles are escaped
by one more backslash after ``<``, which unescaping removes.

Rows are dealt by conversation, sorted by turn (ties by role, then text; null
turns first) and streamed: a task holds one Arrow batch and the machine's
state, however long a conversation is.

Defined cases: null text or role is empty; an undefined transition is formatted
all the same, flagged ``legal = false``, and the machine goes on from the
role's own state; a conversation that ends outside an accepting state has an
illegal end segment; repeated rows are turns of their own; a null conversation
id is a conversation; an empty table gives no segments.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``turn`` is written before a text, with ``{role}``; ``close`` after it; ``end`` after
    the last turn. ``moves[state][role]`` is the next state, from ``start`` to one of ``accepting``."""

    opening: str = "<|im_start|>"
    header_end: str = "\n"
    close: str = "<|im_end|>\n"
    end: str = ""
    loss_roles: frozenset = frozenset({"assistant"})
    start: str = "start"
    accepting: frozenset = frozenset({"assistant"})
    moves: Mapping = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    })

    def __post_init__(self):
        for mark in (self.opening, self.close):
            if not mark.startswith("<|"):
                raise ValueError("marks start with <|, which texts cannot contain once escaped")

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """Next state and whether the transition is defined."""
        to = self.moves.get(state, {}).get(role)
        return (role, False) if to is None else (to, True)


CHATML = Template()
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<(\\+)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "<" + m.group(1)[1:] + "|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), unescape(text))


SEGMENTS = "conv long, turn int, segment int, text string, loss boolean, legal boolean"


def _emit(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
    columns = zip(*rows, strict=True) if rows else ((),) * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                      ["conv", "turn", "segment", "text", "loss", "legal"])


def _format(template: Template):
    def run(batches):
        conv, turn, state, opened = None, 0, template.start, False
        end = lambda: (conv, turn, 0, template.end, False, state in template.accepting)
        for batch in batches:
            rows = []
            for c, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not opened or c != conv:
                    if opened:
                        rows.append(end())
                    conv, turn, state, opened = c, 0, template.start, True
                role = role or ""
                state, legal = template.step(state, role)
                rows.append((c, turn, 0, f"{template.opening}{escape_role(role)}{template.header_end}", False, legal))
                rows.append((c, turn, 1, escape(text or ""), role in template.loss_roles, legal))
                rows.append((c, turn, 2, template.close, False, legal))
                turn += 1
            yield _emit(rows)
        if opened:
            yield _emit([end()])

    return run


def format_conversations(conversations: DataFrame, template: Template = CHATML, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments (conv, turn from 0, segment, text, loss, legal); the rows of a conversation
    are consecutive and in order within their partition."""
    rows = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
                                F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.select("conv", "role", "text").mapInArrow(_format(template), SEGMENTS)


class _Reader:
    """Reads one formatted conversation, segment by segment."""

    def __init__(self, template: Template, conv) -> None:
        self.template, self.conv = template, conv
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.legal, self.open = True, ""

    def feed(self, text: str, loss: bool, legal: bool) -> None:
        t = self.template
        self.chars += len(text)
        self.legal &= legal
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.open += text
        if self.open.endswith(t.close) and self.open.startswith(t.opening):
            role, _, body = self.open[len(t.opening) : -len(t.close)].partition(t.header_end)
            self.all.update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
            self.turns += 1
            self.open = ""

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.legal


def read_back(segments: DataFrame, template: Template = CHATML) -> DataFrame:
    """Per conversation, parsed from its segments in order: turns, digest of the turns,
    characters and digest of the text under the loss mask, formatted characters, and whether the turn order was legal."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "legal_order"]

    def emit(rows):
        columns = zip(*rows, strict=True) if rows else ((),) * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches):
        reader = None
        for batch in batches:
            rows = []
            for conv, text, loss, legal in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if reader is None or reader.conv != conv:
                    if reader is not None:
                        rows.append(reader.row())
                    reader = _Reader(template, conv)
                reader.feed(text, loss, legal)
            yield emit(rows)
        if reader is not None:
            yield emit([reader.row()])

    return segments.select("conv", "text", "loss", "legal").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, legal_order boolean")
