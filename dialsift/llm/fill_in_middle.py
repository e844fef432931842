"""Fill-in-middle transformation with a sparse exception index.

A text is cut twice and its three parts are reordered around sentinels so that a model learns
to fill the middle. Cuts are counted in units (tokens, code points or bytes), texts are UTF-8:
every cut must be known as a byte offset, to slice, and as a code-point offset, to report.
The index records multibyte characters only (position and excess bytes); one
``searchsorted`` converts either kind of offset to the other, and where no such
character lies before a cut the two are equal.

The cuts of a row depend on its id and the seed alone: h1 to h4 are the first four 32-bit groups of
sha256("<seed>:<id>"); with n units the cuts are h1 and h2 modulo n+1 in order, h3 decides
whether the row is transformed and h4 which order the parts take.

Defined cases: null text is empty; an empty text, and one that holds a sentinel, stays plain
and is marked so; a null id hashes as the empty string; rows are handled one by one, so ties and
repeated rows give equal results; an empty table gives an empty table; an input column named like
the result is replaced, any other stays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Joined, in_chunks, text_bytes

UNITS = ("token", "char", "byte")
BLOCK = 512
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


class ExceptionIndex:
    """Byte and code-point offsets of UTF-8 ``data``, from its multibyte characters alone."""

    def __init__(self, data: np.ndarray) -> None:
        self.byte_at = np.flatnonzero(data >= 0xC0)  # lead bytes
        lead = data[self.byte_at]
        self.excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.before = np.concatenate(([0], np.cumsum(self.excess)))
        self.code_at = self.byte_at - self.before[:-1]

    def to_codes(self, at: np.ndarray) -> np.ndarray:
        """Code points before each byte offset ``at`` (the start of a character or the end)."""
        return at - self.before[np.searchsorted(self.byte_at, at)]

    def to_bytes(self, at: np.ndarray) -> np.ndarray:
        """Byte offset of each code-point offset ``at``."""
        return at + self.before[np.searchsorted(self.code_at, at)]

    def floor(self, at: np.ndarray) -> np.ndarray:
        """The start of the character that each byte offset lies in."""
        if not len(self.byte_at):
            return at
        k = np.maximum(np.searchsorted(self.byte_at, at) - 1, 0)
        inside = (self.byte_at[k] < at) & (at <= self.byte_at[k] + self.excess[k])
        return np.where(inside, self.byte_at[k], at)


class Marks:
    """The set positions of a mask, by rank, with counts of blocks instead of a list of positions."""

    def __init__(self, mask: np.ndarray) -> None:
        self.blocks = np.pad(mask, (0, -len(mask) % BLOCK)).reshape(-1, BLOCK)
        self.before = np.concatenate(([0], np.cumsum(self.blocks.sum(axis=1))))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set positions before each offset."""
        block, rest = np.divmod(at, BLOCK)
        inside = np.append(self.blocks, np.zeros((1, BLOCK), bool), axis=0)[block] & (np.arange(BLOCK) < rest[:, None])
        return self.before[block] + inside.sum(axis=1)

    def place(self, rank: np.ndarray) -> np.ndarray:
        """Offset of the set position that has ``rank`` set positions before it."""
        block = np.searchsorted(self.before, rank, side="right") - 1
        left = rank - self.before[block]
        return block * BLOCK + (self.blocks[block].cumsum(axis=1) <= left[:, None]).sum(axis=1)


def token_starts(data: np.ndarray) -> np.ndarray:
    """True where a token of `[A-Za-z]+|[^A-Za-z]` starts; texts must be parted by non-letters."""
    letter = LETTER[data]
    starts = (data & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return starts


def cuts(texts: list[bytes], h1: np.ndarray, h2: np.ndarray, unit: str) -> np.ndarray:
    """For each text: units, bytes before the two cuts, code points of prefix and middle."""
    out = [np.zeros((0, 5), np.int64)]
    for a, b in in_chunks(texts):
        j = Joined(texts[a:b])
        index = ExceptionIndex(j.data)
        code = index.to_codes(j.starts)
        if unit == "token":
            marks = Marks(token_starts(j.data))
            first = marks.rank(j.starts)
            n = marks.rank(j.ends) - first
        elif unit == "char":
            n = index.to_codes(j.ends) - code
        else:
            n = j.ends - j.starts
        x, y = h1[a:b] % (n + 1), h2[a:b] % (n + 1)
        at = np.stack([np.minimum(x, y), np.maximum(x, y)])
        if unit == "token":  # the separator after a text starts the token of rank n
            at = np.stack([marks.place(first + c) for c in at])
        elif unit == "char":
            at = index.to_bytes(code + at)
        else:
            at = index.floor(j.starts + at)
        codes = index.to_codes(at.ravel()).reshape(2, -1)
        out.append(np.stack([n, at[0] - j.starts, at[1] - j.starts, codes[0] - code, codes[1] - codes[0]], axis=1))
    return np.concatenate(out)


CUT_FIELDS = ("n", "cut1", "cut2", "prefix_chars", "middle_chars")


def _cut_column(unit: str):
    @F.arrow_udf("struct<" + ", ".join(f"{f}: long" for f in CUT_FIELDS) + ">")
    def cut(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        found = cuts(text_bytes(texts), h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False), unit)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in found.T], CUT_FIELDS)

    return cut


def _word32(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, unit: str = "token", rate: int = 90, spm: int = 20, seed: int = 1,
                   sentinels: Sentinels = Sentinels(), id_col: str = "doc_id", text_col: str = "text",
                   out_col: str = "fim") -> DataFrame:
    """``docs`` with a struct ``out_col``: n (units), form (plain, psm or spm), prefix_chars, middle_chars
    (code points, null if plain) and text. ``rate`` in 100 rows are transformed, ``spm`` in 100 of them
    put the suffix first."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"), 256)
    plain = (text == "") | (F.pmod(_word32(digest, 2), F.lit(100)) >= rate)
    for mark in sentinels.all():
        plain = plain | F.contains(text, F.lit(mark))
    form = F.when(plain, "plain").when(F.pmod(_word32(digest, 3), F.lit(100)) < spm, "spm").otherwise("psm")
    rows = docs.withColumn(out_col, _cut_column(unit)(text, _word32(digest, 0), _word32(digest, 1)))
    cut = {f: F.col(f"`{out_col}`.{f}") for f in CUT_FIELDS}
    raw = text.cast("binary")
    prefix = F.substring(raw, F.lit(1), cut["cut1"].cast("int"))
    middle = F.substring(raw, (cut["cut1"] + 1).cast("int"), (cut["cut2"] - cut["cut1"]).cast("int"))
    suffix = F.substring(raw, (cut["cut2"] + 1).cast("int"), F.octet_length(raw))
    p, s, m = (F.lit(x.encode()) for x in sentinels.all())
    output = (F.when(form == "plain", raw).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle))
              .otherwise(F.concat(p, prefix, s, suffix, m, middle)))
    moved = form != "plain"
    return rows.withColumn(out_col, F.struct(
        cut["n"].alias("n"), form.alias("form"), F.when(moved, cut["prefix_chars"]).alias("prefix_chars"),
        F.when(moved, cut["middle_chars"]).alias("middle_chars"), output.cast("string").alias("text")))


def restore(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The exact text again. No part holds a sentinel, and no sentinel overlaps itself or another one,
    so the sentinels of ``output`` are the only places that match."""
    quoted = "|".join("\\Q" + x + "\\E" for x in sentinels.all())
    parts = F.split(output, quoted, -1)
    at = lambda k: F.get(parts, F.lit(k))
    return (F.when(form == "psm", F.concat(at(1), at(3), at(2)))
            .when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output))
