"""Column-expression helpers shared by every operator.

All helpers return JVM-side ``Column`` expressions, so they stay inside
whole-stage codegen. ANSI mode stays on: every division goes through
``safe_div`` (``try_divide`` -> NULL instead of a DIVIDE_BY_ZERO error).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_or_null(c: str | Column) -> Column:
    """NaN, +inf and -inf become NULL (the reference maps them to NaN = missing).

    One comparison: Spark orders NaN above +inf, so ``abs(x) < inf`` is false
    exactly for NaN and ±inf (and NULL stays NULL)."""
    c = col(c)
    return F.when(F.abs(c) < F.lit(_INF), c)


def nan_to_null(c: str | Column) -> Column:
    """NaN -> NULL only (Spark orders NaN above every number, pandas treats it as missing)."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / den as double; zero denominators and non-finite results give NULL."""
    return finite_or_null(F.try_divide(col(num).cast("double"), col(den).cast("double")))


def row_sum(cols: Iterable[str | Column]) -> Column:
    """Row-wise sum skipping NULL; all-NULL gives 0 (pandas ``sum(axis=1)``)."""
    parts = [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def row_count_present(cols: Iterable[str | Column]) -> Column:
    parts = [F.when(col(c).isNotNull(), F.lit(1)).otherwise(F.lit(0)) for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def row_mean(cols: Iterable[str | Column]) -> Column:
    """Row-wise mean skipping NULL; all-NULL gives NULL (pandas ``mean(axis=1)``)."""
    cols = list(cols)
    return F.try_divide(row_sum(cols), row_count_present(cols).cast("double"))


def uniform(key: str | Column, seed: int, tag: str) -> Column:
    """Key-hashed uniform draw in [0, 1).

    u = first 8 hex digits of md5("key|seed|tag") / 2^32. The same value is
    computable in any SQL engine with md5, so random operators get exact oracles,
    and it is a pure function of the row: retried tasks draw the same numbers.
    """
    h = F.md5(F.concat_ws("|", col(key).cast("string"), F.lit(str(seed)), F.lit(tag)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint").cast("double") / F.lit(4294967296.0)


def uniform_sql(key_sql: str, seed: int, tag: str) -> str:
    """DuckDB form of :func:`uniform` for oracle queries."""
    return (
        f"(('0x' || substr(md5(concat_ws('|', CAST({key_sql} AS VARCHAR), '{seed}', '{tag}')), 1, 8))::BIGINT"
        f" / 4294967296.0)"
    )
