"""The ``attempts`` view: one call-attempt row per order.

The reference reads one wide pipe-delimited table of call attempts. The test
tables do not contain one, so this view derives it from ``orders`` and
``customer`` (definition in FIXTURES.md §3). It exists twice: as a Spark plan
(``attempts``) and as DuckDB SQL (``attempts_sql``) for the oracle.

Plan shape: the trailing-window counts are a partial+final hash aggregate of
the last 12 months of orders keyed by customer (filters pushed into the
parquet scan), joined to ``customer`` on the same key, then joined to all
orders. AQE turns either join into a broadcast when a side turns out small
and splits a customer holding a large share of the orders (skew join).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PERIODS
from .tables import read_table

# Fixed values of the derived view (FIXTURES.md §3).
REF_DATE = _dt.date(2001, 8, 1)
MEASURES = ("GestTotales", "GestEfect", "GestDirecto", "GestSinContacto")
ESTADO_CIVIL_VALUES = ("Soltero", "Casado", "Viudo")  # by c_custkey % 3


def _months_back(d: _dt.date, m: int) -> _dt.date:
    y, mo = divmod(d.year * 12 + (d.month - 1) - m, 12)
    return _dt.date(y, mo + 1, d.day)


def period_months(p: str) -> int:
    return int(p.replace("UM", ""))


def avg_columns() -> list[str]:
    cols = []
    for meas in MEASURES:
        cols += [f"AVG_{meas}_CallOut_{p}" for p in PERIODS]
    cols += [f"AVG_GEST_WPP_OUT_{p}" for p in PERIODS]
    return cols


ATTEMPT_COLUMNS = [
    "CODIGO", "PERIODO", "GRUPO_CAPITAL", "Edad", "GEnero", "Estado_civil", "FLAG_DEPENDIENTE",
    "producto_cat", "GRUPO_CANAL", "capitalactualsol", "dias_mora_cartera", "meses_empresa",
    *avg_columns(), "capital_dup", "const_col", "CD",
]


def _ts(d: _dt.date):
    return F.expr(f"TIMESTAMP_NTZ'{d.isoformat()} 00:00:00'")


def _measure_flag(meas: str):
    if meas == "GestTotales":
        return F.lit(True)
    if meas == "GestEfect":
        return F.col("o_orderstatus").isin("F", "O")
    if meas == "GestDirecto":
        return F.col("o_orderstatus") == "F"
    if meas == "GestSinContacto":
        return F.col("o_orderstatus") == "P"
    if meas == "WPP":
        return F.col("o_orderpriority") == "5-LOW"
    raise KeyError(meas)


def _avg_name(meas: str, p: str) -> str:
    return f"AVG_GEST_WPP_OUT_{p}" if meas == "WPP" else f"AVG_{meas}_CallOut_{p}"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")

    upper = _ts(REF_DATE + _dt.timedelta(days=1))
    oldest = _ts(_months_back(REF_DATE, max(period_months(p) for p in PERIODS)))
    recent = orders.where((F.col("o_orderdate") >= oldest) & (F.col("o_orderdate") < upper))
    aggs = []
    for p in PERIODS:
        in_p = F.col("o_orderdate") >= _ts(_months_back(REF_DATE, period_months(p)))
        for meas in (*MEASURES, "WPP"):
            aggs.append(F.count_if(in_p & _measure_flag(meas)).alias(f"n_{meas}_{p}"))
    per_cust = recent.groupBy(F.col("o_custkey").alias("r_custkey")).agg(*aggs)
    avg_cols = []
    for p in PERIODS:
        m = float(period_months(p))
        for meas in (*MEASURES, "WPP"):
            avg_cols.append(
                F.when(F.col(f"n_GestTotales_{p}") > 0, F.col(f"n_{meas}_{p}").cast("double") / F.lit(m)).alias(
                    _avg_name(meas, p)
                )
            )
    cust = customer.join(per_cust, customer.c_custkey == per_cust.r_custkey, "left")
    joined = orders.join(cust, orders.o_custkey == cust.c_custkey, "inner")

    k = F.col("c_custkey")
    out = joined.select(
        F.col("o_orderkey").alias("CODIGO"),
        F.lit("2001-08").alias("PERIODO"),
        F.when(F.col("c_acctbal") >= 0, F.lit("POS")).otherwise(F.lit("NEG")).alias("GRUPO_CAPITAL"),
        F.when(k % 17 == 0, F.lit(None).cast("double")).otherwise((F.lit(18) + k % 60).cast("double")).alias("Edad"),
        F.when(k % 11 == 0, F.lit(None).cast("string"))
        .when(k % 2 == 0, F.lit("F"))
        .otherwise(F.lit("M"))
        .alias("GEnero"),
        F.when(k % 13 == 0, F.lit(None).cast("string"))
        .when(k % 3 == 0, F.lit(ESTADO_CIVIL_VALUES[0]))
        .when(k % 3 == 1, F.lit(ESTADO_CIVIL_VALUES[1]))
        .otherwise(F.lit(ESTADO_CIVIL_VALUES[2]))
        .alias("Estado_civil"),
        (k % 2).cast("string").alias("FLAG_DEPENDIENTE"),
        F.col("c_mktsegment").alias("producto_cat"),
        F.col("o_orderstatus").alias("GRUPO_CANAL"),
        F.col("c_acctbal").cast("double").alias("capitalactualsol"),
        F.datediff(F.lit(REF_DATE), F.to_date("o_orderdate")).cast("double").alias("dias_mora_cartera"),
        (k % 120).cast("double").alias("meses_empresa"),
        *avg_cols,
        (F.col("c_acctbal") * F.lit(1.01)).alias("capital_dup"),
        F.lit(1.0).alias("const_col"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("CD"),
    )
    return out.select(*ATTEMPT_COLUMNS)


def attempts_sql() -> str:
    """DuckDB SQL of the same view (a CTE body named ``attempts``)."""
    upper = (REF_DATE + _dt.timedelta(days=1)).isoformat()
    oldest = _months_back(REF_DATE, max(period_months(p) for p in PERIODS)).isoformat()
    flags = {
        "GestTotales": "TRUE",
        "GestEfect": "o_orderstatus IN ('F', 'O')",
        "GestDirecto": "o_orderstatus = 'F'",
        "GestSinContacto": "o_orderstatus = 'P'",
        "WPP": "o_orderpriority = '5-LOW'",
    }
    counts, avgs = [], {}
    for p in PERIODS:
        cut = _months_back(REF_DATE, period_months(p)).isoformat()
        m = float(period_months(p))
        for meas, flag in flags.items():
            counts.append(
                f"sum(CASE WHEN o_orderdate >= TIMESTAMP '{cut}' AND {flag} THEN 1 ELSE 0 END) AS n_{meas}_{p}"
            )
            avgs[_avg_name(meas, p)] = (
                f"CASE WHEN r.n_GestTotales_{p} > 0 THEN CAST(r.n_{meas}_{p} AS DOUBLE) / {m} END"
            )
    cols = {
        "CODIGO": "o.o_orderkey",
        "PERIODO": "'2001-08'",
        "GRUPO_CAPITAL": "CASE WHEN c.c_acctbal >= 0 THEN 'POS' ELSE 'NEG' END",
        "Edad": "CASE WHEN c.c_custkey % 17 = 0 THEN NULL ELSE CAST(18 + c.c_custkey % 60 AS DOUBLE) END",
        "GEnero": "CASE WHEN c.c_custkey % 11 = 0 THEN NULL WHEN c.c_custkey % 2 = 0 THEN 'F' ELSE 'M' END",
        "Estado_civil": (
            "CASE WHEN c.c_custkey % 13 = 0 THEN NULL WHEN c.c_custkey % 3 = 0 THEN '{0}' "
            "WHEN c.c_custkey % 3 = 1 THEN '{1}' ELSE '{2}' END"
        ).format(*ESTADO_CIVIL_VALUES),
        "FLAG_DEPENDIENTE": "CAST(c.c_custkey % 2 AS VARCHAR)",
        "producto_cat": "c.c_mktsegment",
        "GRUPO_CANAL": "o.o_orderstatus",
        "capitalactualsol": "CAST(c.c_acctbal AS DOUBLE)",
        "dias_mora_cartera": f"CAST(date_diff('day', CAST(o.o_orderdate AS DATE), DATE '{REF_DATE.isoformat()}') AS DOUBLE)",
        "meses_empresa": "CAST(c.c_custkey % 120 AS DOUBLE)",
        **avgs,
        "capital_dup": "c.c_acctbal * 1.01",
        "const_col": "1.0::DOUBLE",
        "CD": "CAST(o.o_orderpriority = '1-URGENT' AS INTEGER)",
    }
    select = ",\n    ".join(f"{cols[c]} AS {c}" for c in ATTEMPT_COLUMNS)
    return f"""cust_recent AS (
  SELECT o_custkey AS r_custkey,
    {', '.join(counts)}
  FROM orders
  WHERE o_orderdate >= TIMESTAMP '{oldest}' AND o_orderdate < TIMESTAMP '{upper}'
  GROUP BY o_custkey
), attempts AS (
  SELECT
    {select}
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN cust_recent r ON r.r_custkey = c.c_custkey
)"""
