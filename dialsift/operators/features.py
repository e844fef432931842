"""Derived features.

Every generator reads only input columns (never another derived column), so
all of them are one ``withColumns`` projection: the plan stays a single
Project inside whole-stage codegen. A feature is produced only when its
inputs exist (B6). Non-finite results and zero denominators become NULL (B5,
S1), and NULLs of the created columns are then filled with their exact
median (C6, one distributed job for all of them).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EPS_RATIO, FEATURE_TYPES, PERIODS
from ..functions.exprs import finite_or_null, row_mean, row_sum, safe_div
from .clean import apply_fill
from .stats import exact_medians



@dataclass(frozen=True)
class Spec:
    """One derived column: ``op`` over input column names ``args``.

    ops: ``div`` a / (b + k); ``trend`` (a - b) / (b + 1); ``mul_log1p``
    a * log1p(b); ``log1p_mul_log1p`` log1p(a) * log1p(b); ``row_sum``;
    ``row_mean``. Rendered to Spark columns here and to SQL for the oracle."""

    name: str
    op: str
    args: tuple[str, ...]
    k: float = 0.0


def _ratio_specs(cols: set[str]) -> list[Spec]:
    """16 ratios per period (+1e-6 in the denominator)."""
    out = []
    for p in PERIODS:
        efect, total = f"AVG_GestEfect_CallOut_{p}", f"AVG_GestTotales_CallOut_{p}"
        directo, sin = f"AVG_GestDirecto_CallOut_{p}", f"AVG_GestSinContacto_CallOut_{p}"
        if efect in cols and total in cols:
            out.append(Spec(f"Ratio_Efectividad_{p}", "div", (efect, total), EPS_RATIO))
        if directo in cols and efect in cols:
            out.append(Spec(f"Ratio_Directo_de_Efectivas_{p}", "div", (directo, efect), EPS_RATIO))
        if sin in cols and total in cols:
            out.append(Spec(f"Ratio_SinContacto_{p}", "div", (sin, total), EPS_RATIO))
    for p in PERIODS:
        wpp, total = f"AVG_GEST_WPP_OUT_{p}", f"AVG_GestTotales_CallOut_{p}"
        if wpp in cols and total in cols:
            out.append(Spec(f"Ratio_WhatsApp_Total_{p}", "div", (wpp, total), EPS_RATIO))
    return out


def _trend_specs(cols: set[str]) -> list[Spec]:
    """(recent - old) / (old + 1), 3UM vs 12UM."""
    out = []
    for g in ("GestTotales", "GestEfect", "GestDirecto", "GestSinContacto"):
        recent, old = f"AVG_{g}_CallOut_3UM", f"AVG_{g}_CallOut_12UM"
        if recent in cols and old in cols:
            out.append(Spec(f"Tendencia_{g}_3vs12", "trend", (recent, old)))
    recent, old = "AVG_GEST_WPP_OUT_3UM", "AVG_GEST_WPP_OUT_12UM"
    if recent in cols and old in cols:
        out.append(Spec("Tendencia_WhatsApp_3vs12", "trend", (recent, old)))
    return out


def _density_specs(cols: set[str]) -> list[Spec]:
    """Calls per day overdue, capital per day overdue, calls per month employed."""
    out = []
    mora = "dias_mora_cartera"
    if mora in cols:
        for p in PERIODS:
            g = f"AVG_GestTotales_CallOut_{p}"
            if g in cols:
                out.append(Spec(f"Densidad_Gestiones_por_DiaMora_{p}", "div", (g, mora), 1.0))
    if "capitalactualsol" in cols and mora in cols:
        out.append(Spec("Capital_por_DiaMora", "div", ("capitalactualsol", mora), 1.0))
    if "meses_empresa" in cols:
        for p in ("3UM", "6UM"):
            g = f"AVG_GestTotales_CallOut_{p}"
            if g in cols:
                out.append(Spec(f"Densidad_Gestiones_por_MesEmpresa_{p}", "div", (g, "meses_empresa"), 1.0))
    return out


def _interaction_specs(cols: set[str]) -> list[Spec]:
    """C4: products with log1p (log1p(x <= -1) is NULL, S2)."""
    out = []
    mora, cap, age = "dias_mora_cartera", "capitalactualsol", "Edad"
    if age in cols and mora in cols:
        out.append(Spec("Interaccion_Edad_DiaMora", "mul_log1p", (age, mora)))
    if cap in cols and mora in cols:
        out.append(Spec("Interaccion_Capital_DiaMora", "log1p_mul_log1p", (cap, mora)))
    if age in cols and cap in cols:
        out.append(Spec("Interaccion_Edad_Capital", "mul_log1p", (age, cap)))
    return out


def _aggregation_specs(cols: set[str]) -> list[Spec]:
    """Row-wise sums (NULL skipped, all-NULL -> 0) and mean (all-NULL -> NULL)."""
    out = []
    efect = tuple(c for c in (f"AVG_GestEfect_CallOut_{p}" for p in PERIODS) if c in cols)
    directo = tuple(c for c in (f"AVG_GestDirecto_CallOut_{p}" for p in PERIODS) if c in cols)
    wpp = tuple(c for c in (f"AVG_GEST_WPP_OUT_{p}" for p in PERIODS) if c in cols)
    if efect:
        out.append(Spec("Total_GestEfect_AllPeriods", "row_sum", efect))
    if directo:
        out.append(Spec("Total_GestDirecto_AllPeriods", "row_sum", directo))
    if wpp:
        out.append(Spec("Promedio_WhatsApp_AllPeriods", "row_mean", wpp))
    return out


_GENERATORS = {
    "ratio": _ratio_specs,
    "trend": _trend_specs,
    "density": _density_specs,
    "interaction": _interaction_specs,
    "aggregation": _aggregation_specs,
}


def feature_specs(columns: Sequence[str], feature_types: Sequence[str] = FEATURE_TYPES) -> list[Spec]:
    cols = set(columns)
    out: list[Spec] = []
    for t in FEATURE_TYPES:
        if t in feature_types:
            out += _GENERATORS[t](cols)
    return out


def to_column(spec: Spec) -> Column:
    a = [F.col(x).cast("double") for x in spec.args]
    if spec.op == "div":
        return safe_div(a[0], a[1] + F.lit(spec.k))
    if spec.op == "trend":
        return safe_div(a[0] - a[1], a[1] + F.lit(1.0))
    if spec.op == "mul_log1p":
        return finite_or_null(a[0] * F.log1p(a[1]))
    if spec.op == "log1p_mul_log1p":
        return finite_or_null(F.log1p(a[0]) * F.log1p(a[1]))
    if spec.op == "row_sum":
        return row_sum(spec.args)
    if spec.op == "row_mean":
        return row_mean(spec.args)
    raise KeyError(spec.op)


def to_sql(spec: Spec) -> str:
    """DuckDB text of the same column (oracle only)."""
    a = list(spec.args)

    def fin(e: str) -> str:
        return f"(CASE WHEN isfinite({e}) THEN {e} END)"

    def log1p(e: str) -> str:
        return f"(CASE WHEN {e} > -1.0::DOUBLE THEN ln(1.0::DOUBLE + {e}) END)"

    if spec.op == "div":
        return fin(f"CAST({a[0]} AS DOUBLE) / NULLIF(CAST({a[1]} AS DOUBLE) + {spec.k!r}::DOUBLE, 0)")
    if spec.op == "trend":
        return fin(f"(CAST({a[0]} AS DOUBLE) - CAST({a[1]} AS DOUBLE)) / NULLIF(CAST({a[1]} AS DOUBLE) + 1.0::DOUBLE, 0)")
    if spec.op == "mul_log1p":
        return fin(f"CAST({a[0]} AS DOUBLE) * {log1p(a[1])}")
    if spec.op == "log1p_mul_log1p":
        return fin(f"{log1p(a[0])} * {log1p(a[1])}")
    if spec.op == "row_sum":
        return "(" + " + ".join(f"coalesce(CAST({x} AS DOUBLE), 0.0::DOUBLE)" for x in a) + ")"
    if spec.op == "row_mean":
        s = "(" + " + ".join(f"coalesce(CAST({x} AS DOUBLE), 0.0::DOUBLE)" for x in a) + ")"
        n = "(" + " + ".join(f"(CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END)" for x in a) + ")"
        return f"({s} / NULLIF(CAST({n} AS DOUBLE), 0))"
    raise KeyError(spec.op)


def feature_exprs(columns: Sequence[str], feature_types: Sequence[str] = FEATURE_TYPES) -> dict[str, Column]:
    return {s.name: to_column(s) for s in feature_specs(columns, feature_types)}


def add_features(df: DataFrame, feature_types: Sequence[str] = FEATURE_TYPES) -> tuple[DataFrame, list[str]]:
    """All requested generators in one projection; returns (df, created names)."""
    exprs = feature_exprs(df.columns, feature_types)
    return df.withColumns(exprs), list(exprs)


def missing_report(df: DataFrame, created: Sequence[str]) -> DataFrame:
    """(feature, n_missing) for created features with at least one NULL.
    One aggregate of ``count_if`` for all columns, unpivoted."""
    created = [c for c in created if c in df.columns]
    if not created:
        return df.sparkSession.createDataFrame([], "feature string, n_missing bigint")
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"m{k}") for k, c in enumerate(created)])
    stack = ", ".join(f"'{c}', m{k}" for k, c in enumerate(created))
    long = wide.selectExpr(f"stack({len(created)}, {stack}) AS (feature, n_missing)")
    return long.where(F.col("n_missing") > 0).select("feature", F.col("n_missing").cast("bigint"))


def create_all_features(
    df: DataFrame, feature_types: Sequence[str] = FEATURE_TYPES
) -> tuple[DataFrame, list[str], dict[str, float | None]]:
    """Project all features, then fill each created column's NULLs with
    its exact median over all rows. Returns (df, created, medians used)."""
    out, created = add_features(df, feature_types)
    medians = exact_medians(out, created)
    return apply_fill(out, medians), created, medians
