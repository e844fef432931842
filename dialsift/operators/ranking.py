"""Ranking evaluation: how many calls, in score order, find X % of the contacts.

Input everywhere is a *scores* table ``(estrategia, key, score, y)``; any
number of strategies are evaluated in one plan. The gain curve is the global
"sort by score desc, cumulative sum" of the reference, computed with
:func:`running_totals` (range slices + offsets) so no step needs one task to
hold a whole strategy. Every summary afterwards is a partial+final hash
aggregate over the curve keyed by strategy.

Ties: score desc, then key asc (the reference's sort is not stable, S12).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BUSINESS_WEIGHTS, MILESTONES, RANDOM_STRATEGY, TOPK_SHARES
from ..functions.exprs import nan_to_null, uniform
from .ordered import running_totals
from .stats import minmax

CURVE_COLUMNS = [
    "estrategia", "key", "contacto_real", "proba", "contactos_acum",
    "porcentaje_contactos", "llamadas_realizadas", "porcentaje_llamadas",
]


# ---------------------------------------------------------------- scores

def business_score(
    df: DataFrame,
    capital_col: str | None = "capitalactualsol",
    age_col: str | None = "Edad",
    dependent_col: str | None = None,
    weights: Sequence[float] = BUSINESS_WEIGHTS,
    out_col: str = "score",
) -> DataFrame:
    """0.5·minmax(capital) + 0.3·minmax(age) + 0.2·dependent.

    minmax(x) = (x - min) / (max - min + 1e-6) over ``df``. A column that is
    absent (or ``None``) contributes 0, as in the reference where the
    dependent flag no longer exists after one-hot encoding (S15). The min/max
    row is one global aggregate (one row, broadcast)."""
    scaled = {f"_scaled_{name}": c for name, c in (("capital", capital_col), ("age", age_col)) if c and c in df.columns}
    out = df.withColumns({tmp: F.col(c) for tmp, c in scaled.items()}) if scaled else df
    if scaled:
        out = minmax(out, list(scaled))

    def part(name: str) -> Column:
        return F.col(f"_scaled_{name}") if f"_scaled_{name}" in scaled else F.lit(0.0)

    dep = F.col(dependent_col).cast("double") if dependent_col and dependent_col in df.columns else F.lit(0.0)
    w_cap, w_age, w_dep = weights
    score = part("capital") * F.lit(w_cap) + part("age") * F.lit(w_age) + dep * F.lit(w_dep)
    return out.withColumn(out_col, score).drop(*scaled)


def random_score(df: DataFrame, key: str, seed: int, out_col: str = "score") -> DataFrame:
    """Uniform score per row from a hash of (key, seed)."""
    return df.withColumn(out_col, uniform(key, seed, "baseline"))


def scores_table(df: DataFrame, key: str, label: str, strategies: Mapping[str, Column]) -> DataFrame:
    """``(estrategia, key, score, y)`` for every strategy, in one pass over
    ``df``: each input row emits one row per strategy (``stack`` unpivot), so
    the input plan is scanned once, not once per strategy."""
    names = list(strategies)
    wide = df.select(
        F.col(key).cast("bigint").alias("key"),
        F.col(label).cast("int").alias("y"),
        *[nan_to_null(strategies[n].cast("double")).alias(f"_s{i}") for i, n in enumerate(names)],
    )
    body = ", ".join(f"'{n.replace(chr(39), chr(39) * 2)}', _s{i}" for i, n in enumerate(names))
    return wide.selectExpr(f"stack({len(names)}, {body}) AS (estrategia, score)", "key", "y").select(
        "estrategia", "key", "score", "y"
    )


# ---------------------------------------------------------------- curve

def _curve_with_totals(scores: DataFrame, num_slices: int | None = None) -> DataFrame:
    cur = running_totals(
        scores,
        order_by=[F.col("score").desc(), F.col("key").asc(), F.col("y").asc()],
        partition_by=["estrategia"],
        sums={"contactos_acum": F.col("y").cast("bigint")},
        rank_col="llamadas_realizadas",
        num_slices=num_slices,
        totals_prefix="_total_",
    )
    return cur.select(
        "estrategia",
        "key",
        F.col("y").alias("contacto_real"),
        F.col("score").alias("proba"),
        F.col("contactos_acum").cast("bigint").alias("contactos_acum"),
        (F.try_divide(F.col("contactos_acum").cast("double"), F.col("_total_contactos_acum").cast("double"))
         * F.lit(100.0)).alias("porcentaje_contactos"),
        "llamadas_realizadas",
        (F.col("llamadas_realizadas").cast("double") / F.col("_total_n").cast("double") * F.lit(100.0)).alias(
            "porcentaje_llamadas"
        ),
        F.col("_total_n").cast("bigint").alias("_total_intentos"),
        F.col("_total_contactos_acum").cast("bigint").alias("_total_contactos"),
    )


def gain_curve(scores: DataFrame, num_slices: int | None = None) -> DataFrame:
    """Per strategy and row: running contacts, rank, both as %."""
    return _curve_with_totals(scores, num_slices).select(*CURVE_COLUMNS)


# ---------------------------------------------------------------- summaries

def strategy_summary(curve_t: DataFrame, milestones: Sequence[int] = MILESTONES,
                     shares: Sequence[int] = TOPK_SHARES) -> DataFrame:
    """One row per strategy: first call reaching each milestone, contacts in
    the first k % of calls, totals. One partial+final aggregate."""
    aggs = [
        F.first("_total_intentos").alias("total_intentos"),
        F.first("_total_contactos").alias("total_contactos"),
    ]
    for h in milestones:
        aggs.append(F.min(F.when(F.col("porcentaje_contactos") >= F.lit(float(h)), F.col("llamadas_realizadas")))
                    .alias(f"_m{h}"))
    for k in shares:
        cut = (F.col("_total_intentos").cast("double") * F.lit(k / 100.0)).cast("bigint")
        aggs.append(F.sum(F.when(F.col("llamadas_realizadas") <= cut, F.col("contacto_real"))).alias(f"_c{k}"))
    out = curve_t.groupBy("estrategia").agg(*aggs)
    for h in milestones:
        reached = F.col(f"_m{h}")
        out = out.withColumn(f"llamadas_{h}", F.coalesce(reached, F.col("total_intentos")).cast("bigint")).withColumn(
            f"pct_{h}",
            F.when(reached.isNull(), F.lit(100.0)).otherwise(
                reached.cast("double") / F.col("total_intentos").cast("double") * F.lit(100.0)
            ),
        )
    for k in shares:
        kk = (F.col("total_intentos").cast("double") * F.lit(k / 100.0)).cast("bigint")
        out = out.withColumn(
            f"tasa_top_{k}",
            F.try_divide(F.coalesce(F.col(f"_c{k}"), F.lit(0)).cast("double"), kk.cast("double")) * F.lit(100.0),
        )
    return out.drop(*[f"_m{h}" for h in milestones], *[f"_c{k}" for k in shares])


def milestones(scores: DataFrame, hitos: Sequence[int] = MILESTONES, num_slices: int | None = None) -> DataFrame:
    """Long table ``(estrategia, hito, llamadas, porcentaje_dataset)``."""
    summ = strategy_summary(_curve_with_totals(scores, num_slices), hitos)
    stack = ", ".join(f"{h}, llamadas_{h}, pct_{h}" for h in hitos)
    return summ.selectExpr(
        "estrategia", f"stack({len(hitos)}, {stack}) AS (hito, llamadas, porcentaje_dataset)"
    ).select("estrategia", F.col("hito").cast("int"), F.col("llamadas").cast("bigint"), "porcentaje_dataset")


def topk_rates(scores: DataFrame, num_slices: int | None = None) -> DataFrame:
    """Contacts found per 100 calls in the first 10/20/50 %."""
    summ = strategy_summary(_curve_with_totals(scores, num_slices))
    return summ.select("estrategia", *[f"tasa_top_{k}" for k in TOPK_SHARES])


def compare_strategies(scores: DataFrame, num_slices: int | None = None) -> DataFrame:
    """Wide comparison (I6): calls and % of data per milestone, top-k rates."""
    summ = strategy_summary(_curve_with_totals(scores, num_slices))
    cols = ["estrategia"]
    for h in MILESTONES:
        cols += [f"llamadas_{h}", f"pct_{h}"]
    cols += [f"tasa_top_{k}" for k in TOPK_SHARES]
    return summ.select(*cols)


def business_metrics(scores: DataFrame, num_slices: int | None = None) -> DataFrame:
    """Per strategy business table."""
    s = strategy_summary(_curve_with_totals(scores, num_slices))
    contacts = F.col("total_contactos").cast("double")
    return s.select(
        F.col("estrategia").alias("Estrategia"),
        F.col("llamadas_80").alias("llamadas_para_80"),
        F.col("llamadas_100").alias("llamadas_para_100"),
        F.try_divide(F.col("llamadas_80").cast("double"), contacts * F.lit(0.80)).alias("llamadas_por_contacto_80"),
        F.try_divide(F.col("llamadas_100").cast("double"), contacts).alias("llamadas_por_contacto_100"),
        F.col("tasa_top_10").alias("tasa_exito_top10"),
        F.col("tasa_top_20").alias("tasa_exito_top20"),
        F.col("pct_80").alias("dataset_usado_80"),
        F.col("pct_100").alias("dataset_usado_100"),
    )


def improvement_80(scores: DataFrame, baseline: str = RANDOM_STRATEGY, num_slices: int | None = None) -> DataFrame:
    """Calls saved to reach 80 % vs the random baseline (I8); empty without a baseline."""
    bm = business_metrics(scores, num_slices)
    base = bm.where(F.col("Estrategia") == baseline).select(
        F.col("llamadas_para_80").alias("_b80"), F.col("tasa_exito_top10").alias("tasa_exito_top10_aleatorio")
    )
    # the baseline side is one row per baseline name: a bounded broadcast
    j = bm.where(F.col("Estrategia") != baseline).crossJoin(F.broadcast(base))
    red = F.col("_b80") - F.col("llamadas_para_80")
    return j.select(
        "Estrategia",
        red.cast("bigint").alias("reduccion_llamadas"),
        (F.try_divide(red.cast("double"), F.col("_b80").cast("double")) * F.lit(100.0)).alias("mejora_pct"),
        "tasa_exito_top10",
        "tasa_exito_top10_aleatorio",
    )


def improvement_all(scores: DataFrame, baseline: str = RANDOM_STRATEGY, num_slices: int | None = None) -> DataFrame:
    """Calls saved vs the random baseline for every strategy × milestone."""
    ms = milestones(scores, num_slices=num_slices)
    base = ms.where(F.col("estrategia") == baseline).select("hito", F.col("llamadas").alias("_bl"))
    j = ms.where(F.col("estrategia") != baseline).join(F.broadcast(base), "hito")  # ≤ 5 rows
    red = F.col("_bl") - F.col("llamadas")
    return j.select(
        F.col("estrategia").alias("Estrategia"),
        F.concat(F.col("hito").cast("string"), F.lit("%")).alias("Objetivo"),
        red.cast("bigint").alias("Reduccion_llamadas"),
        (F.try_divide(red.cast("double"), F.col("_bl").cast("double")) * F.lit(100.0)).alias("mejora_pct"),
    )


def improvement_pivot(improvement: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """Objetivo × Estrategia with two value columns per strategy.
    Strategy names are passed in so the pivot needs no distinct job."""
    return improvement.groupBy("Objetivo").pivot("Estrategia", list(strategies)).agg(
        F.first("Reduccion_llamadas").alias("reduccion"), F.first("mejora_pct").alias("mejora_pct")
    )


# ---------------------------------------------------------------- animation data

def curve_frames(scores: DataFrame, fps: int = 20, seconds: int = 20, num_slices: int | None = None) -> DataFrame:
    """Down-sampled curve: for frame f of F = fps·seconds, the row
    idx = min(int(f/F·N), N-1) of each strategy (I11). An equi-join of the
    curve with F frame rows per strategy, so the output is F rows per
    strategy at any input size."""
    total_frames = fps * seconds
    cur = _curve_with_totals(scores, num_slices)
    spark = scores.sparkSession
    frames = spark.range(total_frames).select(F.col("id").cast("int").alias("frame"))
    totals = cur.groupBy("estrategia").agg(F.first("_total_intentos").alias("_N"))
    targets = totals.crossJoin(frames).select(
        "estrategia",
        "frame",
        (F.least(
            (F.col("frame").cast("double") / F.lit(float(total_frames)) * F.col("_N").cast("double")).cast("bigint"),
            F.col("_N") - F.lit(1),
        ) + F.lit(1)).alias("llamadas_realizadas"),
    )
    j = cur.join(F.broadcast(targets), ["estrategia", "llamadas_realizadas"])  # frames × strategies rows
    return j.select(
        "estrategia",
        "frame",
        F.col("llamadas_realizadas").alias("llamadas"),
        F.col("contactos_acum").alias("contactos"),
        (F.try_divide(F.col("contactos_acum").cast("double"), F.col("_total_contactos").cast("double"))
         * F.lit(100.0)).alias("pct_contactos"),
        (F.col("contactos_acum").cast("double") / F.col("llamadas_realizadas").cast("double") * F.lit(100.0)).alias(
            "tasa_exito"
        ),
    )


# Progress thresholds of the reference's animation.
STATUS_DONE, STATUS_TARGET = 99.0, 80.0
BAND_THRESHOLDS = (10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 70.0, 80.0, 90.0, 95.0, 99.0, 99.5)


def progress_band(frames: DataFrame, pct_col: str = "pct_contactos") -> DataFrame:
    """Status text and colour band of each frame (I12): 13 bands, lower bounds
    0, 10, 20, ..., 90, 95, 99, 99.5."""
    p = F.col(pct_col)
    status = (
        F.when(p >= F.lit(STATUS_DONE), F.lit("COMPLETADO"))
        .when(p >= F.lit(STATUS_TARGET), F.lit("OBJETIVO"))
        .otherwise(F.lit("BUSCANDO"))
    )
    band = F.lit(0.0)
    for t in BAND_THRESHOLDS:
        band = F.when(p >= F.lit(t), F.lit(t)).otherwise(band)
    band_idx = F.lit(0)
    for i, t in enumerate(BAND_THRESHOLDS, start=1):
        band_idx = F.when(p >= F.lit(t), F.lit(i)).otherwise(band_idx)
    return frames.withColumn("estado", status).withColumn("banda_desde", band).withColumn("banda", band_idx)


def base_rate(df: DataFrame, label: str = "CD") -> DataFrame:
    """Totals: attempts, contacts, contact rate in %."""
    return df.agg(
        F.count(F.lit(1)).alias("total_intentos"),
        F.sum(F.col(label).cast("bigint")).alias("total_contactos"),
    ).withColumn(
        "tasa_base", F.try_divide(F.col("total_contactos").cast("double"), F.col("total_intentos").cast("double"))
        * F.lit(100.0)
    )
