"""Helpers shared by the text operators: table access, intermediate tables in the
shared folder, Arrow text buffers and vectorised byte hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_shared as materialise

WHITE = b" \t\n\x0b\x0c\r"  # fixed value: [\x20\x09-\x0D]
CHUNK_BYTES = 1 << 20

__all__ = ["CHUNK_BYTES", "WHITE", "Joined", "grams", "hot_join", "in_chunks", "materialise", "mix", "numbered", "table", "text_bytes", "text_list"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame, out_col: str) -> DataFrame:
    """``docs`` with a long column that tells its rows apart, the same in every execution:
    unlike ``monotonically_increasing_id`` it does not change with the cores that are
    registered when the files are split and packed into partitions.

    Rows of a Parquet table (columns of it only) have the place of their file among the sorted
    paths and their index in it; any other DataFrame is numbered in a copy in the shared folder."""
    files = _files(docs)
    if files is None:
        return materialise(docs.withColumn(out_col, F.monotonically_increasing_id()), "numbered")
    path, place = f"{out_col}_path", f"{out_col}_file"
    places = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), f"`{path}` string, `{place}` long")
    rows = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(out_col))
    rows = rows.join(F.broadcast(places), path)  # one row for each file
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), (F.shiftleft(place, 40) + F.col(out_col)).alias(out_col))


def _files(docs: DataFrame) -> list[str] | None:
    """The sorted paths of a Parquet table's files; None where path and row index are not known to be unique."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() == "Project":
        plan = plan.child()
    if not plan.nodeName().startswith(("LogicalRelation", "Relation")):
        return None
    try:
        places = docs.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:  # another format, or a column of that name
        return None
    found = places.groupBy("path").agg(F.count("*").alias("n"), F.max("at").alias("last")).collect()
    if any(r["n"] != r["last"] + 1 for r in found):  # a file that is listed twice
        return None
    return sorted(r["path"] for r in found)


HOT_KEYS = 1000


def hot_join(rows: DataFrame, named: DataFrame, keys: list[str], n_rows: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``named``, which has one row for each key and in ``n`` the number of its rows.
    Keys with over 1/HOT_KEYS of ``n_rows``, at least all rows, are fewer than HOT_KEYS: these are broadcast, so no task
    gets all rows of such a key. The others meet in a shuffle. ``rows`` is read twice and should be cheap to read."""
    hot = F.col("n") * HOT_KEYS > n_rows
    few = F.broadcast(named.filter(hot))
    found = rows.join(few, keys)
    rest = rows.join(F.broadcast(named.filter(hot).select(*keys)), keys, "left_anti").join(named.filter(~hot), keys, how)
    return found.unionByName(rest)


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    return [b if b is not None else b"" for b in column.cast(pa.large_binary()).to_pylist()]


def text_list(column) -> list[str]:
    return [t if t is not None else "" for t in column.to_pylist()]


def in_chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``limit`` bytes (one text
    longer than that is a range of its own), so that vectorised work uses
    memory in proportion to a chunk, not to an Arrow batch."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


class Joined:
    """Texts of a chunk in one byte array, ``sep`` after each of them, with
    prefix sums of a polynomial hash: the hash of any byte span costs O(1).

    Hash of bytes b[i:j] = sum(R[b[k]] * B^(k-i)) mod 2^64 with odd B and a
    table R of random 64-bit numbers, finished by a bit mixer."""

    _rng = np.random.Generator(np.random.PCG64(20240607))
    RANDOM = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, texts: list[bytes], sep: bytes = b"\n") -> None:
        self.raw = sep.join(texts) + sep if texts else b""
        self.data = np.frombuffer(self.raw, np.uint8)
        lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.ends = np.cumsum(lens + len(sep)) - len(sep)  # exclusive end of each text
        self.starts = self.ends - lens
        self._prefix = None

    def _sums(self) -> None:
        n = len(self.data)
        powers = np.empty(n + 1, np.uint64)
        powers[0] = 1
        powers[1:] = np.uint64(self.BASE)
        np.cumprod(powers, out=powers)
        self._prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(self.RANDOM[self.data] * powers[:-1], out=self._prefix[1:])
        powers[1:] = np.uint64(self.INVERSE)
        np.cumprod(powers, out=powers)
        self._back = powers

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte spans [starts, ends)."""
        if self._prefix is None:
            self._sums()
        return mix((self._prefix[ends] - self._prefix[starts]) * self._back[starts])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, text index) of the runs of non-white bytes."""
        white = np.ones(len(self.data) + 1, bool)
        white[:-1] = WHITE_TABLE[self.data]
        edges = np.flatnonzero(white[1:] != white[:-1]) + 1
        if len(self.data) and not white[0]:
            edges = np.concatenate(([0], edges))
        starts, ends = edges[0::2], edges[1::2]
        return starts, ends, np.searchsorted(self.ends, starts, side="right")


WHITE_TABLE = np.zeros(256, bool)
WHITE_TABLE[list(WHITE)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def grams(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive words from each position that has n."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + word_hash[k : k + m]
    return mix(out)
