"""Statistics: exact medians, pairwise-complete correlations, pruning,
class counts and weights, standard scaling (D1-D10, part of B3/C6).

Fits return small driver-side values (one number per column or per column
pair, never per row); transforms are column expressions.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CORRELATION_THRESHOLD
from ..functions.exprs import finite_or_null, safe_div

# ---------------------------------------------------------------- exact median

INSIDE_LIMIT = 1_000_000  # rows a bracket may hold before it is narrowed again


def exact_medians(df: DataFrame, cols: Sequence[str], accuracy: int = 10_000, inside_limit: int = INSIDE_LIMIT) -> dict[str, float | None]:
    """Exact median (midpoint of the two middle values, NULLs skipped) of
    each column, as a distributed selection over the wide rows.

    Spark's ``median``/``percentile`` keeps every distinct value of a column
    in one buffer. Instead:

    1. one aggregate for all columns: counts and a bracket around the middle from
       ``percentile_approx`` (rank error <= n/accuracy, so ± 3/accuracy holds it);
    2. one aggregate: how many values lie below and inside each bracket. Brackets
       with more than ``inside_limit`` rows are narrowed by repeating 1 and 2 inside them;
    3. the values inside the brackets, counted by value; a window over these few rows
       per column finds the two middle ranks, of which at most 2 rows per column are fetched.

    A bracket that misses the middle ranks is opened to the whole column, so the result is always exact."""
    names = {f"_m{k}": c for k, c in enumerate(cols)}
    wide = df.select(*[finite_or_null(F.col(c).cast("double")).alias(m) for m, c in names.items()])
    out: dict[str, float | None] = {c: None for c in cols}
    if not names:
        return out
    counted = wide.agg(*[F.count(m).alias(m) for m in names], *_brackets({m: (None, 0.5) for m in names}, accuracy)).first()
    total = {m: counted[m] for m in names if counted[m]}
    bracket = {m: tuple(counted[f"q{m}"]) for m in total}
    if not bracket:
        return out
    ranks = {m: ((n + 1) // 2, (n + 2) // 2) for m, n in total.items()}
    below: dict[str, int] = {}
    missed: dict[str, int] = dict.fromkeys(bracket, 0)
    pending = set(bracket)
    while pending:
        row = wide.agg(*[F.count_if(F.col(m) < F.lit(bracket[m][0])).alias(f"b{m}") for m in pending],
                       *[F.count_if(_inside(m, bracket[m])).alias(f"i{m}") for m in pending]).first()
        narrow = {}
        for m in sorted(pending):
            below[m], inside = row[f"b{m}"], row[f"i{m}"]
            if ranks[m][0] <= below[m] or ranks[m][1] > below[m] + inside:
                bracket[m] = (-math.inf, math.inf)  # the whole column
                missed[m] += 1
            elif inside > inside_limit and bracket[m][0] < bracket[m][1] and missed[m] < 2:
                narrow[m] = (bracket[m], (ranks[m][0] - below[m] - 0.5) / inside)
            else:
                pending.discard(m)
        if narrow:
            found = wide.agg(*_brackets(narrow, accuracy)).first()
            for m in narrow:
                if (again := tuple(found[f"q{m}"])) == bracket[m]:
                    pending.discard(m)  # as narrow as values allow
                bracket[m] = again
    rows = F.array_compact(F.array(*[F.when(_inside(m, q), F.struct(F.lit(m).alias("c"), F.col(m).alias("v"))) for m, q in bracket.items()]))
    hist = wide.select(F.explode(rows).alias("r")).select("r.c", "r.v").groupBy("c", "v").agg(F.count(F.lit(1)).alias("cnt"))
    start = F.create_map(*[F.lit(x) for m in bracket for x in (m, below[m])])[F.col("c")]
    low, high = (F.create_map(*[F.lit(x) for m in bracket for x in (m, ranks[m][k])])[F.col("c")] for k in (0, 1))
    upto = start + F.sum("cnt").over(Window.partitionBy("c").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = hist.withColumn("upto", upto).withColumn("first", F.col("upto") - F.col("cnt"))
    ends = ranked.select("c", "v", ((F.col("first") < low) & (low <= F.col("upto"))).alias("lo"),
                         ((F.col("first") < high) & (high <= F.col("upto"))).alias("hi")).filter("lo OR hi").collect()
    for m in bracket:
        lo = next(r["v"] for r in ends if r["c"] == m and r["lo"])
        hi = next(r["v"] for r in ends if r["c"] == m and r["hi"])
        out[names[m]] = lo + 0.5 * (hi - lo)  # interpolation form of SQL median
    return out


def _inside(m: str, bracket):
    return F.col(m).between(F.lit(bracket[0]), F.lit(bracket[1]))


def _brackets(of: Mapping[str, tuple], accuracy: int) -> list:
    """Values around the share ``p`` of a column's values inside a bracket (None: all)."""
    d = 3.0 / accuracy
    return [F.percentile_approx(F.col(m) if q is None else F.when(_inside(m, q), F.col(m)), [max(0.0, p - d), min(1.0, p + d)], accuracy).alias(f"q{m}")
            for m, (q, p) in of.items()]


# ---------------------------------------------------------------- correlations

_CORR_SCHEMA = T.StructType(
    [
        T.StructField("i", T.IntegerType()),
        T.StructField("j", T.IntegerType()),
        T.StructField("n", T.DoubleType()),
        T.StructField("sx", T.DoubleType()),
        T.StructField("sy", T.DoubleType()),
        T.StructField("sxx", T.DoubleType()),
        T.StructField("syy", T.DoubleType()),
        T.StructField("sxy", T.DoubleType()),
    ]
)


TILE = 128  # columns on a side of a tile
MERGED = 64  # partial results of a tile that meet in one task
TILES_ON_A_SIDE = 8  # tiles of one pass: a square of 8 by 8 of them, 6 * 64 * 128² numbers in a task

Tile = tuple[range, range]


def _passes(p: int) -> list[list[Tile]]:
    """The upper triangle of column pairs, in tiles of at most TILE by TILE and squares of tiles: a pass reads the
    columns of one square only."""
    blocks = [range(k, min(k + TILE, p)) for k in range(0, p, TILE)]
    out: dict[tuple[int, int], list[Tile]] = {}
    for n, a in enumerate(blocks):
        for m in range(n, len(blocks)):
            out.setdefault((n // TILES_ON_A_SIDE, m // TILES_ON_A_SIDE), []).append((a, blocks[m]))
    return list(out.values())


def _numbers(batch) -> np.ndarray:
    """Rows of the array column; missing and non-finite values are NaN."""
    column = batch.column(0)
    x = np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    x[~np.isfinite(x)] = np.nan
    return x


def _sums_by_column(batches):
    total = None
    for batch in batches:
        if batch.num_rows:
            x = _numbers(batch)
            part = np.nansum(x, axis=0), (~np.isnan(x)).sum(axis=0)
            total = part if total is None else tuple(a + b for a, b in zip(total, part))
    if total is not None:
        yield pa.RecordBatch.from_pydict({"k": np.arange(len(total[0]), dtype=np.int32), "total": total[0], "n": total[1].astype(np.int64)})


def _gram_partials(tiles: list[Tile], place: dict[int, int], shift: np.ndarray):
    """Per task, masked moment matrices of the shifted columns of each tile:
    n_ij, Σx_i|j, Σx_j|i, Σx_i²|j, Σx_j²|i, Σx_i x_j, summed over the rows
    where both i and j are present."""

    def fn(batches):
        acc = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _numbers(batch) - shift
            m = (~np.isnan(x)).astype(np.float64)
            x0 = np.where(m > 0, x, 0.0)
            x2 = x0 * x0
            if acc is None:
                acc = [np.zeros((6, len(a), len(b))) for a, b in tiles]
            for (a, b), out in zip(tiles, acc):
                i, j = [place[k] for k in a], [place[k] for k in b]
                for slot, (left, right) in enumerate(((m, m), (x0, m), (m, x0), (x2, m), (m, x2), (x0, x0))):
                    out[slot] += left[:, i].T @ right[:, j]
        for n, out in enumerate(acc or []):
            yield pa.RecordBatch.from_pydict({"tile": pa.array([n], pa.int32()), "sums": pa.array([out.tobytes()], pa.binary())})

    return fn


def _add_up(rows: pa.Table) -> pa.Table:
    """The sum of the partial results of one tile."""
    total = None
    for sums in rows["sums"]:
        own = np.frombuffer(sums.as_buffer())
        total = own if total is None else total + own
    return pa.table({"tile": rows["tile"][:1], "sums": pa.array([total.tobytes()], pa.binary())})


def _as_rows(tiles: list[Tile]):
    """One row for each pair i < j of the summed tiles."""

    def fn(batches):
        for batch in batches:
            for n, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                a, b = tiles[n]
                i, j = np.meshgrid(np.array(a), np.array(b), indexing="ij")
                own, values = i < j, np.frombuffer(sums.as_buffer()).reshape(6, len(a), len(b))
                yield pa.RecordBatch.from_pydict({"i": i[own].astype(np.int32), "j": j[own].astype(np.int32)}
                                                 | {name: v[own] for name, v in zip(("n", "sx", "sy", "sxx", "syy", "sxy"), values)})

    return fn


def _pair_correlations(df: DataFrame, cols: Sequence[str], passes: list[list[Tile]], absolute: bool = True) -> DataFrame:
    """(col_i, col_j, r) of the pairs i < j of the tiles, in passes over the columns that they need."""
    spark = df.sparkSession

    def rows(used):
        return df.select(F.array(*[F.col(cols[k]).cast("double") for k in used]).alias("x"))

    # shift each column by its mean: covariances do not change, raw moments stay well conditioned
    shift = np.zeros(len(cols))
    means = rows(range(len(cols))).mapInArrow(_sums_by_column, "k int, total double, n long").groupBy("k").agg(
        (F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("m"))
    for r in means.collect():  # one row a column
        shift[r["k"]] = r["m"] if r["m"] is not None and np.isfinite(r["m"]) else 0.0
    parts, kind = [], "tile int, sums binary"
    for tiles in passes:
        used = sorted({k for tile in tiles for side in tile for k in side})
        partial = rows(used).mapInArrow(_gram_partials(tiles, {k: n for n, k in enumerate(used)}, shift[used]), kind)
        # in two levels, so that what meets in one task is bounded by MERGED partial results, whatever their number
        level = partial.groupBy(F.floor(F.spark_partition_id() / MERGED).alias("branch"), "tile").applyInArrow(_add_up, kind)
        parts.append(level.groupBy("tile").applyInArrow(_add_up, kind).mapInArrow(_as_rows(tiles), _CORR_SCHEMA))
    sums = functools.reduce(DataFrame.unionByName, parts)
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    tol = F.lit(1e-12)
    r = F.when(
        (F.col("n") > 1) & (vx > tol * F.greatest(F.col("sxx"), F.lit(1e-300)))
        & (vy > tol * F.greatest(F.col("syy"), F.lit(1e-300))),
        F.least(F.greatest(cov / F.sqrt(vx * vy), F.lit(-1.0)), F.lit(1.0)),
    )
    if len(cols) <= TILE:
        names = F.array(*[F.lit(c) for c in cols])
        return sums.select(F.element_at(names, F.col("i") + 1).alias("col_i"), F.element_at(names, F.col("j") + 1).alias("col_j"),
                           (F.abs(r) if absolute else r).alias("r"))
    named = F.broadcast(spark.createDataFrame(list(enumerate(cols)), "k int, name string"))  # one row a column
    out = sums.select("i", "j", (F.abs(r) if absolute else r).alias("r"))
    out = out.join(named.select(F.col("k").alias("i"), F.col("name").alias("col_i")), "i").join(named.select(F.col("k").alias("j"), F.col("name").alias("col_j")), "j")
    return out.select("col_i", "col_j", "r")


def correlation_pairs(df: DataFrame, cols: Sequence[str], absolute: bool = True) -> DataFrame:
    """Pearson r for every pair i < j of ``cols`` (D1), pairwise-complete:
    each pair uses the rows where both are non-NULL (pandas ``corr``). Zero
    variance gives NULL (pandas NaN), so such columns are never pruned (S8).

    Each task multiplies its Arrow batches into masked moment matrices (NumPy), one for each tile of at most TILE by TILE
    column pairs; these are summed by tile, in two levels, and r is a column
    expression on the summed moments. Up to a thousand columns are one pass; more take one for each square
    of tiles, reading the columns of these tiles only, so that memory does not grow with the number of columns.
    Columns are shifted by their means first (one more aggregate) so the
    raw-moment formula does not lose precision."""
    cols = list(cols)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col_i string, col_j string, r double")
    return _pair_correlations(df, cols, _passes(len(cols)), absolute)


def correlation_drop_list(pairs: DataFrame, cols: Sequence[str], threshold: float = CORRELATION_THRESHOLD) -> list[str]:
    """Columns to drop (D2, S9): column j goes when any earlier column i
    (i < j in column order, dropped or not) has |r| > threshold."""
    hit = pairs.where(F.col("r") > F.lit(threshold)).select("col_j").distinct()
    dropped = {r["col_j"] for r in hit.collect()}  # at most one row per column
    return [c for c in cols if c in dropped]


def target_correlations(df: DataFrame, cols: Sequence[str], target: str = "CD") -> DataFrame:
    """|r| of each column with the target (D3 input), pairwise-complete, as
    (Feature, Correlacion_Abs): tiles of one column, so only pairs with the target are computed."""
    cols = [c for c in cols if c != target]
    if not cols:
        return df.sparkSession.createDataFrame([], "Feature string, Correlacion_Abs double")
    last = range(len(cols), len(cols) + 1)
    pairs = _pair_correlations(df, [*cols, target], [[(range(k, min(k + TILE, len(cols))), last)] for k in range(0, len(cols), TILE)])
    return pairs.select(F.col("col_i").alias("Feature"), F.col("r").alias("Correlacion_Abs"))


def target_correlation_topn(df: DataFrame, cols: Sequence[str], created: Sequence[str], target: str = "CD",
                            top_n: int = 20) -> DataFrame | None:
    """Top-N |r| with the target, NULL last, ties by name; ``Es_Creada`` flags
    engineered features (D3). None when the target is absent."""
    if target not in df.columns:
        return None
    tc = target_correlations(df, cols, target)
    return (
        tc.orderBy(F.col("Correlacion_Abs").desc_nulls_last(), F.col("Feature").asc())
        .limit(top_n)
        .withColumn("Es_Creada", F.col("Feature").isin(list(created)) if created else F.lit(False))
    )


def created_share(topn: DataFrame, top_n: int = 20) -> DataFrame:
    """Count and % of engineered features in the top-N (% over ``top_n``)."""
    return topn.agg(F.sum(F.col("Es_Creada").cast("bigint")).alias("creadas")).select(
        F.coalesce(F.col("creadas"), F.lit(0)).cast("bigint").alias("creadas"),
        (F.coalesce(F.col("creadas"), F.lit(0)).cast("double") / F.lit(float(top_n)) * F.lit(100.0)).alias("pct_creadas"),
    )


# ---------------------------------------------------------------- class statistics


def class_counts(datasets: Mapping[str, DataFrame], label: str = "CD") -> DataFrame:
    """(dataset, label, n) for each named data set."""
    blocks = [
        d.groupBy(F.col(label).cast("int").alias(label)).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("dataset"), label, "n"
        )
        for name, d in datasets.items()
    ]
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out


def scale_pos_weight(df: DataFrame, label: str = "CD") -> DataFrame:
    """n(label=0) / n(label=1)."""
    return df.agg(
        F.try_divide(F.count_if(F.col(label) == 0).cast("double"), F.count_if(F.col(label) == 1).cast("double")).alias(
            "scale_pos_weight"
        )
    )


def balanced_weights(df: DataFrame, label: str = "CD", out_col: str = "weight") -> DataFrame:
    """n / (k · n_c) per row, sklearn's ``class_weight='balanced'``.
    Class counts are one small aggregate joined back (AQE broadcasts it: one
    row per class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.crossJoin(tot).select(
        label, (F.col("_n").cast("double") / (F.col("_k").cast("double") * F.col("_nc").cast("double"))).alias(out_col)
    )
    return df.join(F.broadcast(w), label, "left")


# ---------------------------------------------------------------- scaling


def _merged(parts) -> np.ndarray | None:
    """Count, mean and squared deviations of each column over parts of the rows."""
    total = None
    for n, mean, m2 in parts:
        if total is None:
            total = [n, mean, m2]
            continue
        both = np.maximum(total[0] + n, 1)
        # a part without values changes nothing, be its mean what it may
        gap = np.where((total[0] > 0) & (n > 0), mean - total[1], 0.0)
        total = [total[0] + n, np.where(total[0] > 0, total[1] + gap * n / both, mean), total[2] + m2 + gap * gap * total[0] * n / both]
    return None if total is None else np.stack(total)


def _moments(batches):
    """One row per task: the moments of each position of the array column, NULLs skipped."""

    def parts():
        for batch in batches:
            if batch.num_rows:
                values = batch.column(0).flatten()
                shape = (batch.num_rows, -1)
                known = values.is_valid().to_numpy(zero_copy_only=False).reshape(shape)
                x = np.where(known, values.to_numpy(zero_copy_only=False).astype(float).reshape(shape), 0.0)
                n = known.sum(axis=0).astype(float)
                mean = x.sum(axis=0) / np.maximum(n, 1)
                yield n, mean, (np.where(known, x - mean, 0.0) ** 2).sum(axis=0)

    with np.errstate(invalid="ignore"):
        total = _merged(parts())
    if total is not None:
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})


def _merge_moments(rows: pa.Table) -> pa.Table:
    with np.errstate(invalid="ignore"):
        total = _merged(np.frombuffer(v.as_buffer()).reshape(3, -1) for v in rows["sums"])
    return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})


def fit_standard_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column (S11: zero std -> 1), NULLs skipped. Each task takes the moments of its Arrow
    batches (an aggregate of two functions for each column is too large a method to be compiled); they
    are merged in two levels, as those of ``correlation_pairs``."""
    if not cols:
        return {}
    rows = df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("x")).mapInArrow(_moments, "sums binary")
    level = rows.groupBy(F.floor(F.spark_partition_id() / MERGED).alias("branch")).applyInArrow(_merge_moments, "sums binary")
    row = level.groupBy(F.lit(0).alias("all")).applyInArrow(_merge_moments, "sums binary").first()
    out = {c: (0.0, 1.0) for c in cols}
    if row is not None:
        for c, n, mean, m2 in zip(cols, *np.frombuffer(row["sums"]).reshape(3, -1).tolist(), strict=True):
            s = math.sqrt(m2 / n) if n and m2 >= 0 else math.nan
            out[c] = (mean if n else 0.0, s if s > 0 else 1.0)
    return out


def apply_standard_scaler(df: DataFrame, params: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns(
        {c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()}
    )


def minmax(df: DataFrame, cols: Sequence[str], eps: float = 1e-6) -> DataFrame:
    """(x - min) / (max - min + eps)."""
    stats = df.agg(*[a for c in cols for a in (F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"))])
    j = df.crossJoin(F.broadcast(stats))
    j = j.withColumns(
        {c: safe_div(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + F.lit(eps)) for c in cols}
    )
    return j.drop(*[f"_lo_{c}" for c in cols], *[f"_hi_{c}" for c in cols])
