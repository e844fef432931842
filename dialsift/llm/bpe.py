"""Byte-level BPE: vocabulary file, pre-tokenisation and exact merging.

The vocabulary file (tokenizers JSON) is read once by the driver from a path
the caller names, broadcast (about 1.5 MB, independent of the data), and parsed
once in each Python worker. It is never copied into this package.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import regex
from pyspark import Broadcast
from pyspark.sql import SparkSession

DEFAULT_VOCABULARY = "byte_bpe_50k.json"

# Fixed value: the published pattern that splits text before byte-level merges.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Letters and digits of Unicode 17, which the tokenizers library (Unicode 16) takes as neither.
NEWER = regex.compile(
    "[\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    "\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB"
    "\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016EA0-\U00016EB8"
    "\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20"
    "\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6"
    "\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE"
    "\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF"
    "\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F]")
PRE_TOKEN_16 = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--{NEWER.pattern}]+| ?[\p{{N}}--{NEWER.pattern}]+| ?(?:[^\s\p{{L}}\p{{N}}]|{NEWER.pattern})+|\s+(?!\S)|\s+",
    regex.V1)
ID_BITS = 20
ID_MASK, NO_MERGE = (1 << ID_BITS) - 1, 1 << 60
LONG = 48  # symbols from which merging uses a heap


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


def read_vocabulary(spark: SparkSession, path: str | None = None) -> Broadcast:
    with open(path or default_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _printable_bytes() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    others for the code points from 256 on, in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if chr(b) not in out)
    return out | {chr(256 + k): b for k, b in enumerate(hidden)}


class Bpe:
    def __init__(self, data: bytes) -> None:
        spec = json.loads(data)
        alphabet = _printable_bytes()
        to_bytes = lambda token: bytes(alphabet[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.token_bytes: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = token.encode() if token in self.special else to_bytes(token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        if len(self.token_bytes) > ID_MASK:
            raise ValueError(f"the vocabulary has over {ID_MASK} ids")
        self.byte_id = [0] * 256
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        # pair of ids -> (rank, new id), both packed into one integer
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << ID_BITS | vocab[b]] = rank << ID_BITS | vocab[a + b]

    def _split(self, text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                if NEWER.search(text):
                    return PRE_TOKEN_16.findall(text)
        return PRE_TOKEN.findall(text)

    def words(self, text: str) -> list[str | int]:
        """Pre-tokens in order; a special string of the vocabulary is its id."""
        if self.split_special is None or not any(t in text for t in self.special):
            return self._split(text)
        out: list[str | int] = []
        at = 0
        for m in self.split_special.finditer(text):
            out += self._split(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self._split(text[at:])

    def pieces(self, text: str) -> list[str | int]:
        """Strings whose pre-tokens, one after another, are those of the text.

        Where white space is single spaces and line ends between words, a word with its
        space is a piece: pre-tokens never cross such borders, and pieces repeat,
        so that the pattern runs once for each distinct piece. Other texts come as ``words``."""
        if "\0" in text or " ".join(text.split()) != text.replace("\n", " ") or any(t in text for t in self.special):
            return self.words(text)
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if text else []

    def piece_words(self, piece: str | int) -> list[str | int]:
        if isinstance(piece, int) or piece.isalpha() or (piece[:1] == " " and piece[1:].isalpha()):
            return [piece]  # letters, with a space before them at most
        return self._split(piece)

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token: always the lowest-ranked pair first, leftmost among equals."""
        ids = [self.byte_id[b] for b in word.encode()]
        if len(ids) > LONG:
            return self._merge_long(ids)
        get = self.merges.get
        pairs = [get(a << ID_BITS | b, NO_MERGE) for a, b in zip(ids, ids[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best == NO_MERGE:
                break
            k = pairs.index(best)
            ids[k] = best & ID_MASK
            del ids[k + 1], pairs[k]
            if k:
                pairs[k - 1] = get(ids[k - 1] << ID_BITS | ids[k], NO_MERGE)
            if k < len(pairs):
                pairs[k] = get(ids[k] << ID_BITS | ids[k + 1], NO_MERGE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list: n log n for a pre-token of n bytes."""
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m >> ID_BITS, k, a, b, m & ID_MASK) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False))
                if (m := self.merges.get(a << ID_BITS | b)) is not None]
        heapq.heapify(heap)

        def push(k: int) -> None:
            j = after[k]
            if j < n and (m := self.merges.get(ids[k] << ID_BITS | ids[j])) is not None:
                heapq.heappush(heap, (m >> ID_BITS, k, ids[k], ids[j], m & ID_MASK))

        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = after[k] if alive[k] else n
            if j >= n or ids[k] != a or ids[j] != b:
                continue
            ids[k], alive[j] = new, False
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            push(k)
            if before[k] >= 0:
                push(before[k])
        return [x for x, live in zip(ids, alive, strict=True) if live]


@lru_cache(maxsize=2)
def _parsed(data: bytes) -> Bpe:
    return Bpe(data)


def load(ref: Broadcast) -> Bpe:
    """The parsed vocabulary of this worker process."""
    return _parsed(ref.value)
