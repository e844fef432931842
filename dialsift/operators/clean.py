"""Cleaning: drop columns, fill missing values, drop-first one-hot."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CATEGORICAL, CATEGORY_FILL, DROP_COLUMNS, MEDIAN_FILL
from .stats import exact_medians


def drop_columns(df: DataFrame, cols: Iterable[str] = DROP_COLUMNS, keep: Iterable[str] = ()) -> DataFrame:
    """Drop the listed columns, ignoring absent ones (B1). Names in ``keep``
    (e.g. the row key) survive."""
    keep = set(keep)
    return df.drop(*[c for c in cols if c in df.columns and c not in keep])


def fill_category(df: DataFrame, fills: Mapping[str, str] = CATEGORY_FILL) -> DataFrame:
    """Constant fill for the listed string columns that exist (B2)."""
    present = {c: v for c, v in fills.items() if c in df.columns}
    return df.fillna(present) if present else df


def fit_medians(df: DataFrame, cols: Sequence[str] = MEDIAN_FILL) -> dict[str, float | None]:
    """Exact medians of the listed columns that exist (fit half of B3)."""
    present = [c for c in cols if c in df.columns]
    return exact_medians(df, present) if present else {}


def apply_fill(df: DataFrame, values: Mapping[str, float | None]) -> DataFrame:
    """coalesce(col, value) for every fitted column (transform half of B3)."""
    exprs = {c: F.coalesce(F.col(c), F.lit(v).cast("double")) for c, v in values.items() if v is not None}
    return df.withColumns(exprs) if exprs else df


def fill_median(df: DataFrame, cols: Sequence[str] = MEDIAN_FILL) -> DataFrame:
    return apply_fill(df, fit_medians(df, cols))


MAX_CATEGORIES = 10_000


def fit_categories(df: DataFrame, cols: Sequence[str] = CATEGORICAL, most: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    """Sorted distinct values per categorical column: one distributed distinct of (column, value).
    More than ``most`` values together raise an error: such a column is not categorical."""
    present = [c for c in cols if c in df.columns]
    if not present:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in present])
    found = df.select(F.explode(pairs).alias("p")).select("p.c", "p.v").where("v IS NOT NULL").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} categories in {present}")
    return {c: sorted(r["v"] for r in found if r["c"] == c) for c in present}


def dummy_columns(categories: Mapping[str, list[str]]) -> list[str]:
    return [f"{c}_{v}" for c, vals in categories.items() for v in vals[1:]]


def apply_one_hot(df: DataFrame, categories: Mapping[str, list[str]]) -> DataFrame:
    """Drop-first dummies (B4, S7): the first sorted value is dropped; NULL
    gives all zeros; dummy named ``{col}_{value}`` (boolean, as pandas). The
    encoded columns are removed and dummies are appended in column order."""
    dummies = []
    for c, vals in categories.items():
        for v in vals[1:]:
            dummies.append(F.coalesce(F.col(c).cast("string") == F.lit(v), F.lit(False)).alias(f"{c}_{v}"))
    rest = [F.col(c) for c in df.columns if c not in categories]
    return df.select(*rest, *dummies)


def one_hot_drop_first(df: DataFrame, cols: Sequence[str] = CATEGORICAL) -> DataFrame:
    return apply_one_hot(df, fit_categories(df, cols))
