"""DuckDB SQL that computes what each catalog query computes.

Used only as the correctness oracle (the driver runs it next to the Spark
plan). Tables are the pre-registered parquet views. Literals are DOUBLE (not
DECIMAL) so both engines do the same IEEE arithmetic; double-to-integer casts
truncate explicitly (DuckDB casts round).
"""

from __future__ import annotations

from ..config import BUSINESS_STRATEGY, MILESTONES, RANDOM_STRATEGY, TOPK_SHARES
from ..functions.exprs import uniform_sql
from ..sources.attempts import attempts_sql

D = "::DOUBLE"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


FILLED = """filled AS (
  SELECT * REPLACE (
    coalesce(GEnero, 'Desconocido') AS GEnero,
    coalesce(Estado_civil, 'Desconocido') AS Estado_civil,
    coalesce(Edad, (SELECT median(Edad) FROM attempts)) AS Edad,
    coalesce(dias_mora_cartera, (SELECT median(dias_mora_cartera) FROM attempts)) AS dias_mora_cartera)
  FROM attempts
)"""


def business_score_sql(src: str = "filled") -> str:
    return f"""biz AS (
  SELECT s.*,
    ((capitalactualsol - mm.cmin) / (mm.cmax - mm.cmin + 1e-6)) * 0.5{D}
    + ((Edad - mm.amin) / (mm.amax - mm.amin + 1e-6)) * 0.3{D}
    + 0.0{D} * 0.2{D} AS _biz
  FROM {src} s, (SELECT min(capitalactualsol) AS cmin, max(capitalactualsol) AS cmax,
                        min(Edad) AS amin, max(Edad) AS amax FROM {src}) mm
)"""


RECENCY_STRATEGY = "Recencia"
RANKING_SEED = 73


def attempt_scores_sql() -> str:
    u = uniform_sql("CODIGO", RANKING_SEED, "baseline")
    return f"""scores AS (
  SELECT '{BUSINESS_STRATEGY}' AS estrategia, CAST(CODIGO AS BIGINT) AS key, _biz AS score, CAST(CD AS INTEGER) AS y FROM biz
  UNION ALL
  SELECT '{RANDOM_STRATEGY}', CAST(CODIGO AS BIGINT), {u}, CAST(CD AS INTEGER) FROM biz
  UNION ALL
  SELECT '{RECENCY_STRATEGY}', CAST(CODIGO AS BIGINT), -dias_mora_cartera, CAST(CD AS INTEGER) FROM biz
)"""


def attempt_scores_ctes() -> list[str]:
    return [attempts_sql(), FILLED, business_score_sql(), attempt_scores_sql()]


def lineitem_scores_ctes() -> list[str]:
    return [
        """scores AS (
  SELECT 'Importe' AS estrategia, l_orderkey * 8 + l_linenumber AS key,
    l_extendedprice * (1.0::DOUBLE - l_discount) AS score,
    CAST(l_returnflag = 'R' AS INTEGER) AS y
  FROM lineitem
)"""
    ]


CURVE = """curve_t AS (
  SELECT estrategia, key, y AS contacto_real, score AS proba,
    CAST(sum(y) OVER w AS BIGINT) AS contactos_acum,
    CAST(row_number() OVER w AS BIGINT) AS llamadas_realizadas,
    CAST(count(*) OVER (PARTITION BY estrategia) AS BIGINT) AS _total_intentos,
    CAST(sum(y) OVER (PARTITION BY estrategia) AS BIGINT) AS _total_contactos
  FROM scores
  WINDOW w AS (PARTITION BY estrategia ORDER BY score DESC NULLS LAST, key ASC, y ASC
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), curve AS (
  SELECT estrategia, key, contacto_real, proba, contactos_acum,
    CAST(contactos_acum AS DOUBLE) / NULLIF(CAST(_total_contactos AS DOUBLE), 0) * 100.0::DOUBLE AS porcentaje_contactos,
    llamadas_realizadas,
    CAST(llamadas_realizadas AS DOUBLE) / CAST(_total_intentos AS DOUBLE) * 100.0::DOUBLE AS porcentaje_llamadas,
    _total_intentos, _total_contactos
  FROM curve_t
)"""

CURVE_SELECT = (
    "SELECT estrategia, key, contacto_real, proba, contactos_acum, porcentaje_contactos, "
    "llamadas_realizadas, porcentaje_llamadas FROM curve"
)


def _k(total: str, k: int) -> str:
    return f"CAST(trunc(CAST({total} AS DOUBLE) * {k / 100.0!r}{D}) AS BIGINT)"


def summary_sql() -> str:
    mins = ",\n    ".join(
        f"min(CASE WHEN porcentaje_contactos >= {float(h)!r}{D} THEN llamadas_realizadas END) AS _m{h}"
        for h in MILESTONES
    )
    tops = ",\n    ".join(
        f"sum(CASE WHEN llamadas_realizadas <= {_k('_total_intentos', k)} THEN contacto_real END) AS _c{k}"
        for k in TOPK_SHARES
    )
    cols = []
    for h in MILESTONES:
        cols.append(f"CAST(coalesce(_m{h}, total_intentos) AS BIGINT) AS llamadas_{h}")
        cols.append(
            f"CASE WHEN _m{h} IS NULL THEN 100.0{D} ELSE CAST(_m{h} AS DOUBLE) / CAST(total_intentos AS DOUBLE) "
            f"* 100.0{D} END AS pct_{h}"
        )
    for k in TOPK_SHARES:
        cols.append(
            f"CAST(coalesce(_c{k}, 0) AS DOUBLE) / NULLIF(CAST({_k('total_intentos', k)} AS DOUBLE), 0) "
            f"* 100.0{D} AS tasa_top_{k}"
        )
    return f"""summ0 AS (
  SELECT estrategia, max(_total_intentos) AS total_intentos, max(_total_contactos) AS total_contactos,
    {mins},
    {tops}
  FROM curve GROUP BY estrategia
), summ AS (
  SELECT estrategia, total_intentos, total_contactos,
    {', '.join(cols)}
  FROM summ0
)"""


def milestones_select() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT estrategia, CAST({h} AS INTEGER) AS hito, llamadas_{h} AS llamadas, pct_{h} AS porcentaje_dataset "
        f"FROM summ"
        for h in MILESTONES
    )


BUSINESS_METRICS = f"""bm AS (
  SELECT estrategia AS Estrategia, llamadas_80 AS llamadas_para_80, llamadas_100 AS llamadas_para_100,
    CAST(llamadas_80 AS DOUBLE) / NULLIF(CAST(total_contactos AS DOUBLE) * 0.8{D}, 0) AS llamadas_por_contacto_80,
    CAST(llamadas_100 AS DOUBLE) / NULLIF(CAST(total_contactos AS DOUBLE), 0) AS llamadas_por_contacto_100,
    tasa_top_10 AS tasa_exito_top10, tasa_top_20 AS tasa_exito_top20,
    pct_80 AS dataset_usado_80, pct_100 AS dataset_usado_100
  FROM summ
)"""


def ranking_sql(kind: str, scores_ctes: list[str]) -> str:
    base = [*scores_ctes, CURVE]
    if kind == "gain_curve":
        return with_(*base) + CURVE_SELECT
    base.append(summary_sql())
    if kind == "milestones":
        return with_(*base) + milestones_select()
    if kind == "topk_rates":
        return with_(*base) + "SELECT estrategia, " + ", ".join(f"tasa_top_{k}" for k in TOPK_SHARES) + " FROM summ"
    if kind == "compare_strategies":
        cols = ["estrategia"]
        for h in MILESTONES:
            cols += [f"llamadas_{h}", f"pct_{h}"]
        cols += [f"tasa_top_{k}" for k in TOPK_SHARES]
        return with_(*base) + "SELECT " + ", ".join(cols) + " FROM summ"
    if kind == "business_metrics":
        return with_(*base, BUSINESS_METRICS) + "SELECT * FROM bm"
    if kind == "improvement_80":
        return with_(*base, BUSINESS_METRICS) + f"""SELECT m.Estrategia,
  CAST(b.llamadas_para_80 - m.llamadas_para_80 AS BIGINT) AS reduccion_llamadas,
  CAST(b.llamadas_para_80 - m.llamadas_para_80 AS DOUBLE) / NULLIF(CAST(b.llamadas_para_80 AS DOUBLE), 0) * 100.0{D} AS mejora_pct,
  m.tasa_exito_top10, b.tasa_exito_top10 AS tasa_exito_top10_aleatorio
FROM bm m, (SELECT * FROM bm WHERE Estrategia = '{RANDOM_STRATEGY}') b
WHERE m.Estrategia <> '{RANDOM_STRATEGY}'"""
    if kind in ("improvement_all", "improvement_pivot"):
        imp = f"""ms AS ({milestones_select()}), imp AS (
  SELECT m.estrategia AS Estrategia, CAST(m.hito AS VARCHAR) || '%' AS Objetivo,
    CAST(b.llamadas - m.llamadas AS BIGINT) AS Reduccion_llamadas,
    CAST(b.llamadas - m.llamadas AS DOUBLE) / NULLIF(CAST(b.llamadas AS DOUBLE), 0) * 100.0{D} AS mejora_pct
  FROM ms m JOIN (SELECT hito, llamadas FROM ms WHERE estrategia = '{RANDOM_STRATEGY}') b ON m.hito = b.hito
  WHERE m.estrategia <> '{RANDOM_STRATEGY}'
)"""
        if kind == "improvement_all":
            return with_(*base, imp) + "SELECT * FROM imp"
        sel = ["Objetivo"]
        for s in (BUSINESS_STRATEGY, RECENCY_STRATEGY):
            sel.append(f"first(Reduccion_llamadas) FILTER (WHERE Estrategia = '{s}') AS \"{s}_reduccion\"")
            sel.append(f"first(mejora_pct) FILTER (WHERE Estrategia = '{s}') AS \"{s}_mejora_pct\"")
        return with_(*base, imp) + "SELECT " + ", ".join(sel) + " FROM imp GROUP BY Objetivo"
    raise KeyError(kind)


def curve_frames_sql(scores_ctes: list[str], fps: int = 20, seconds: int = 20, bands: bool = False) -> str:
    f_total = fps * seconds
    frames = f"""tg AS (
  SELECT t.estrategia, CAST(f.frame AS INTEGER) AS frame,
    least(CAST(trunc(CAST(f.frame AS DOUBLE) / {float(f_total)!r}{D} * CAST(t.n AS DOUBLE)) AS BIGINT), t.n - 1) + 1 AS target
  FROM (SELECT estrategia, max(_total_intentos) AS n FROM curve GROUP BY estrategia) t,
       (SELECT range AS frame FROM range({f_total})) f
), fr AS (
  SELECT c.estrategia, tg.frame, c.llamadas_realizadas AS llamadas, c.contactos_acum AS contactos,
    CAST(c.contactos_acum AS DOUBLE) / NULLIF(CAST(c._total_contactos AS DOUBLE), 0) * 100.0{D} AS pct_contactos,
    CAST(c.contactos_acum AS DOUBLE) / CAST(c.llamadas_realizadas AS DOUBLE) * 100.0{D} AS tasa_exito
  FROM curve c JOIN tg ON c.estrategia = tg.estrategia AND c.llamadas_realizadas = tg.target
)"""
    if not bands:
        return with_(*scores_ctes, CURVE, frames) + "SELECT * FROM fr"
    thresholds = (10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 70.0, 80.0, 90.0, 95.0, 99.0, 99.5)
    band = " ".join(f"WHEN pct_contactos >= {t!r}{D} THEN {t!r}{D}" for t in reversed(thresholds))
    idx = " ".join(f"WHEN pct_contactos >= {t!r}{D} THEN {i}" for i, t in reversed(list(enumerate(thresholds, 1))))
    return with_(*scores_ctes, CURVE, frames) + f"""SELECT *,
  CASE WHEN pct_contactos >= 99.0{D} THEN 'COMPLETADO' WHEN pct_contactos >= 80.0{D} THEN 'OBJETIVO' ELSE 'BUSCANDO' END AS estado,
  CASE {band} ELSE 0.0{D} END AS banda_desde,
  CAST(CASE {idx} ELSE 0 END AS INTEGER) AS banda
FROM fr"""


# ------------------------------------------------------------------ prepared features (B, C, D)

# Category lists of the attempts view (its definition fixes them).
KNOWN_CATEGORIES = {
    "GEnero": ["Desconocido", "F", "M"],
    "Estado_civil": ["Casado", "Desconocido", "Soltero", "Viudo"],
    "FLAG_DEPENDIENTE": ["0", "1"],
    "producto_cat": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "GRUPO_CANAL": ["F", "O", "P"],
}


def encoded_columns() -> tuple[list[str], list[str]]:
    """(plain columns after B1 and one-hot, dummy names) in frame order."""
    from ..config import CATEGORICAL, DROP_COLUMNS
    from ..sources.attempts import ATTEMPT_COLUMNS

    plain = [c for c in ATTEMPT_COLUMNS if (c not in DROP_COLUMNS or c == "CODIGO") and c not in CATEGORICAL]
    dummies = [f"{c}_{v}" for c in CATEGORICAL for v in KNOWN_CATEGORIES[c][1:]]
    return plain, dummies


def feature_columns() -> tuple[list[str], list[str]]:
    """(all feature columns in frame order, created ones)."""
    from ..operators.features import feature_specs

    plain, dummies = encoded_columns()
    specs = feature_specs(plain)
    created = [s.name for s in specs]
    feats = [c for c in plain if c not in ("CODIGO", "CD")] + dummies + created
    return feats, created


def feature_ctes(fill_created: bool = True) -> list[str]:
    from ..operators.features import feature_specs, to_sql

    plain, dummies = encoded_columns()
    dsql = []
    for c, vals in KNOWN_CATEGORIES.items():
        for v in vals[1:]:
            dsql.append(f"coalesce({c} = '{v}', false) AS {c}_{v}")
    enc = f"""enc AS (
  SELECT {', '.join(plain)}, {', '.join(dsql)} FROM filled
)"""
    specs = feature_specs(plain)
    feat = "feat AS (\n  SELECT *, " + ",\n    ".join(f"{to_sql(s)} AS {s.name}" for s in specs) + "\n  FROM enc\n)"
    ctes = [attempts_sql(), FILLED, enc, feat]
    if fill_created:
        rep = ", ".join(f"coalesce({s.name}, (SELECT median({s.name}) FROM feat)) AS {s.name}" for s in specs)
        ctes.append(f"featf AS MATERIALIZED (\n  SELECT * REPLACE ({rep}) FROM feat\n)")
    return ctes


def round_sql(cols: list[str], digits: int = 6) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in cols)


def pairs_cte(src: str = "featf", cols: list[str] | None = None) -> str:
    cols = cols or feature_columns()[0]
    aggs, mapping = [], []
    k = 0
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            aggs.append(f"corr(CAST({cols[i]} AS DOUBLE), CAST({cols[j]} AS DOUBLE)) AS p{k}")
            mapping.append(f"('p{k}', '{cols[i]}', '{cols[j]}', {i}, {j})")
            k += 1
    names = ", ".join(f"'p{i}'" for i in range(k))
    return f"""pw AS (SELECT {', '.join(aggs)} FROM {src}),
pl AS (SELECT unnest([{names}]) AS pname, unnest([{', '.join(f'p{i}' for i in range(k))}]) AS rv FROM pw),
pm AS (SELECT * FROM (VALUES {', '.join(mapping)}) t(pname, col_i, col_j, pos_i, pos_j)),
pairs AS (
  SELECT pm.col_i, pm.col_j, pm.pos_i, pm.pos_j,
    CASE WHEN rv IS NULL OR isnan(rv) THEN NULL ELSE least(abs(rv), 1.0::DOUBLE) END AS r
  FROM pl JOIN pm ON pl.pname = pm.pname
)"""


# ------------------------------------------------------------------ splits and class statistics

SPLIT_SEED = 42


def split_ctes(stratify: bool = True, test_size: float = 0.2, src: str = "attempts", key: str = "CODIGO", label: str = "CD") -> list[str]:
    u = uniform_sql(key, SPLIT_SEED, "split")
    if not stratify:
        return [f"""split AS (
  SELECT {key}, {label}, CASE WHEN row_number() OVER (ORDER BY {u}, {key})
      <= CAST(ceil({test_size!r}{D} * CAST(count(*) OVER () AS DOUBLE)) AS BIGINT) THEN 'test' ELSE 'train' END AS split
  FROM {src}
)"""]
    return [f"""cc AS (SELECT {label}, count(*) AS nc FROM {src} GROUP BY {label}),
tt AS (SELECT sum(nc) AS n, CAST(ceil({test_size!r}{D} * CAST(sum(nc) AS DOUBLE)) AS BIGINT) AS n_test FROM cc),
al1 AS (SELECT cc.{label}, cc.nc, tt.n, tt.n_test,
          floor(CAST(cc.nc * (tt.n - tt.n_test) AS DOUBLE) / CAST(tt.n AS DOUBLE)) AS fl,
          CAST(cc.nc * (tt.n - tt.n_test) AS DOUBLE) / CAST(tt.n AS DOUBLE)
            - floor(CAST(cc.nc * (tt.n - tt.n_test) AS DOUBLE) / CAST(tt.n AS DOUBLE)) AS rem
        FROM cc, tt),
al2 AS (SELECT *, row_number() OVER (ORDER BY rem DESC, {label}) AS rk, (n - n_test) - sum(fl) OVER () AS lft FROM al1),
quota AS (SELECT {label}, nc - (CAST(fl AS BIGINT) + CASE WHEN rk <= lft THEN 1 ELSE 0 END) AS test_q FROM al2),
split AS (
  SELECT r.{key}, r.{label}, CASE WHEN r.rn <= q.test_q THEN 'test' ELSE 'train' END AS split
  FROM (SELECT {key}, {label}, row_number() OVER (PARTITION BY {label} ORDER BY {u}, {key}) AS rn FROM {src}) r
  JOIN quota q ON r.{label} = q.{label}
)"""]


def undersample_cte(ratio: float = 0.5, seed: int = SPLIT_SEED) -> str:
    u = uniform_sql("CODIGO", seed, "undersample")
    return f"""trn AS (SELECT CODIGO, CD FROM split WHERE split = 'train'),
us AS (
  SELECT CODIGO, CD FROM trn WHERE CD = 1
  UNION ALL
  SELECT CODIGO, CD FROM (
    SELECT CODIGO, CD, row_number() OVER (ORDER BY {u}, CODIGO) AS rn FROM trn WHERE CD = 0) m
  WHERE rn <= CAST(trunc(CAST((SELECT count(*) FROM trn WHERE CD = 1) AS DOUBLE) / {ratio!r}{D}) AS BIGINT)
)"""


# ------------------------------------------------------------------ linear systems in SQL


def solved(name: str, system: str, size: int) -> str:
    """CTEs whose last, ``name`` (x), solves the symmetric positive system of ``system`` (m: rows with the
    right-hand side as last entry) by Gauss-Jordan steps, one a recursion."""
    return f"""{name}_gj(k, m) AS (SELECT 1, m FROM {system} UNION ALL
  SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k])
    ELSE list_transform(r, lambda v, c: v - r[k] / m[k][k] * m[k][c]) END) FROM {name}_gj WHERE k <= {size}),
{name} AS MATERIALIZED (SELECT list_transform(m, lambda r: r[{size + 1}]) AS x FROM {name}_gj WHERE k = {size + 1})"""


def normal_equations(name: str, rows: str, size: int, penalty: str = "1.0::DOUBLE") -> str:
    """CTE ``name`` (m): sums of s·x·xᵀ plus ``penalty`` on the diagonal, and of s·t·x, over ``rows`` (x, s, t)."""
    return f"""{name} AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (
  SELECT a.i, list_append(list(a.v ORDER BY j), any_value(b.v)) AS r FROM
    (SELECT i, j, sum(s * x[i] * x[j]) + CASE WHEN i = j THEN {penalty} ELSE 0 END AS v
     FROM {rows}, range(1, {size + 1}) p(i), range(1, {size + 1}) q(j) GROUP BY i, j) a
    JOIN (SELECT i, sum(s * t * x[i]) AS v FROM {rows}, range(1, {size + 1}) p(i) GROUP BY i) b ON a.i = b.i GROUP BY a.i))"""


def inverted(name: str, system: str, size: int) -> str:
    """CTEs whose last, ``name`` (m, ld), has the inverse and the log determinant of the symmetric positive matrix of
    ``system`` (m: rows), by Gauss-Jordan steps on the matrix with the identity beside it."""
    return f"""{name}_gj(k, ld, m) AS (SELECT 1, 0.0::DOUBLE,
    list_transform(m, lambda r, i: list_concat(r, list_transform(range(1, {size + 1}), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)))
  FROM {system} UNION ALL
  SELECT k + 1, ld + ln(m[k][k]), list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k])
    ELSE list_transform(r, lambda v, c: v - r[k] / m[k][k] * m[k][c]) END) FROM {name}_gj WHERE k <= {size}),
{name} AS MATERIALIZED (SELECT list_transform(m, lambda r: r[{size + 1}:{2 * size}]) AS m, ld FROM {name}_gj WHERE k = {size + 1})"""
