"""Pipe-delimited attempt files (A1): UTF-8 text with a header row.

With a schema the file is read as it says. Without one the types are inferred as the reference's reader does:
``infer_schema`` takes one pass over the file's Arrow batches, in which each column climbs from 64-bit integer to double to string
(or is boolean throughout), and the same missing markers become NULL. NaN markers
become NULL on read so every later operator sees one kind of missing value.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import nan_to_null


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "|") -> DataFrame:
    df = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("encoding", "UTF-8")
        .option("nanValue", "NaN")
        .option("mode", "FAILFAST")
        .schema(schema)
        .csv(path)
    )
    doubles = [f.name for f in schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in doubles}) if doubles else df


def write_delimited(df: DataFrame, path: str, sep: str = "|") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path)


# Texts that the reference's reader takes for a missing value, besides the empty text.
MISSING = ("#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
           "n/a", "nan", "null")
INTEGER = r"^ *[+-]?[0-9]+ *$"
DOUBLE = r"^ *[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i)inf(inity)?) *$"
END = r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?$"  # as the end of a text in Java's expressions
SHORT_INTEGER = r"^ *[+-]?[0-9]{1,18} *$"  # of 64 bits for sure
BOOLEAN = ("True", "TRUE", "true", "False", "FALSE", "false")


def _raw(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """All columns as text."""
    return (spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").option("mode", "FAILFAST")
            .option("inferSchema", False).csv(path))


def _texts(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """All columns as text, missing markers as NULL."""
    raw = _raw(spark, path, sep)
    return raw.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING, ""), F.col(f"`{c}`")).alias(c) for c in raw.columns])


def _fits(text: str) -> bool:
    """Is a text that looks like an integer one of 64 bits?"""
    text = text.strip("".join(map(chr, range(33))) + "\x7f")
    return re.fullmatch("[+-]?[0-9]+", text) is not None and -(1 << 63) <= int(text) < 1 << 63


def column_levels(column: pa.Array) -> tuple[int | None, int | None, int]:
    """(lowest, highest) level of the values, 0 integer, 1 double, 2 boolean, 3 string, and how many are missing."""
    gone = pc.or_(pc.is_null(column), pc.is_in(column, pa.array([*MISSING, ""], column.type)))
    values = pc.unique(column.filter(pc.invert(gone)))
    missing = pc.sum(gone).as_py() or 0
    if not len(values):
        return None, None, missing
    whole = pc.match_substring_regex(values, INTEGER.replace("$", END))
    short = pc.match_substring_regex(values, SHORT_INTEGER)
    if pc.any(pc.and_not(whole, short)).as_py():
        fits = pa.array([s or (w and _fits(v)) for v, w, s in zip(values.to_pylist(), whole.to_pylist(), short.to_pylist(), strict=True)])
    else:
        fits = short
    levels = set()
    for level, rule in enumerate((lambda v: fits, lambda v: pc.match_substring_regex(v, DOUBLE.replace("$", END)), lambda v: pc.is_in(v, pa.array(BOOLEAN, v.type)))):
        met = rule(values)
        if pc.any(met).as_py():
            levels.add(level)
            values = values.filter(pc.invert(met))
        if not len(values):
            return min(levels), max(levels), missing
    return min(levels, default=3), 3, missing


def _task_levels(batches):
    """One row (place, lo, hi, missing) for each column of a task's rows."""
    seen: dict[int, tuple] = {}
    for batch in batches:
        for k, column in enumerate(batch.columns):
            lo, hi, missing = column_levels(column)
            was = seen.get(k, (None, None, 0))
            seen[k] = (min((x for x in (lo, was[0]) if x is not None), default=None), max((x for x in (hi, was[1]) if x is not None), default=None), missing + was[2])
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in range(3))], ["place", "lo", "hi", "missing"])


def infer_schema(spark: SparkSession, path: str, sep: str = "|") -> T.StructType:
    """Types of all columns from one pass over the whole file: integers with a missing value are doubles (there is no
    missing integer in the reference's tables), booleans with one are strings, a column without values is double."""
    raw = _raw(spark, path, sep)
    tasks = raw.mapInArrow(_task_levels, "place int, lo long, hi long, missing long")
    found = tasks.groupBy("place").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("missing").alias("missing")).collect()
    stats = {r["place"]: r for r in found}  # one row a column

    def kind(k: int) -> T.DataType:
        low, high, missing = (stats[k][c] for c in ("lo", "hi", "missing")) if k in stats else (None, None, 0)
        if high is None or high == 1 or (high == 0 and missing):
            return T.DoubleType()
        if high == 0:
            return T.LongType()
        return T.BooleanType() if low == high == 2 and not missing else T.StringType()

    return T.StructType([T.StructField(c, kind(k)) for k, c in enumerate(raw.columns)])


def read_inferred(spark: SparkSession, path: str, sep: str = "|", schema: T.StructType | None = None) -> DataFrame:
    """A delimited file without a schema: inferred types, missing markers as NULL, non-numbers of numeric columns as errors."""
    schema = schema or infer_schema(spark, path, sep)
    texts = _texts(spark, path, sep)

    def typed(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            return c
        c = F.trim(c)
        if isinstance(f.dataType, T.DoubleType):
            named = F.regexp_replace(c, "(?i)^([+-]?)inf$", "$1Infinity").cast("double")  # only where the plain cast gives nothing
            return nan_to_null(F.coalesce(c.try_cast("double"), named)).alias(f.name)
        return c.cast(f.dataType).alias(f.name)

    return texts.select(*[typed(f) for f in schema.fields])
