"""Prepare stage (Q1): attempts -> clean -> encode -> features -> prune ->
split -> scale. Each fit is one small job whose result (medians, category
lists, drop list, scaler parameters) shapes the next projection; the row data
itself never leaves the executors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CATEGORICAL, MEDIAN_FILL, RunConfig
from ..operators import clean, features, sampling, stats
from ..session import write_shared


def ranking_input(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """An attempt table with categories and medians filled (B2, B3): what the
    business rule scores. With ``columns`` only those are kept, and that
    narrow table is written once before the median fit reads it."""
    if columns is not None:
        df = write_shared(df.select(*columns), "ranking-input")
    return clean.fill_median(clean.fill_category(df))


@dataclass
class Prepared:
    data: DataFrame  # key, features..., target (before split)
    features: list[str]
    created: list[str]
    dropped: list[str]
    categories: dict[str, list[str]]
    medians: dict[str, float | None] = field(default_factory=dict)
    feature_medians: dict[str, float | None] = field(default_factory=dict)


def _cleaned(df: DataFrame, cfg: RunConfig) -> tuple[DataFrame, DataFrame]:
    """(cleaned rows, the rows that fits may see), written once: every later fit reads them."""
    df = clean.fill_category(clean.drop_columns(df, keep=[cfg.key]))
    if cfg.fit_on == "all":
        df = write_shared(df, "cleaned")
        return df, df
    if cfg.fit_on != "train":
        raise ValueError(f"fit_on is 'all' or 'train', not {cfg.fit_on!r}")
    tagged = sampling.stratified_split(df, cfg.key, cfg.target, cfg.test_size, cfg.seed, stratify=cfg.stratify)
    tagged = write_shared(tagged, "cleaned")
    return tagged.drop("split"), tagged.where(F.col("split") == "train").drop("split")


def encoded(df: DataFrame, cfg: RunConfig | None = None) -> tuple[DataFrame, dict, dict]:
    """B1-B4 on an attempt table; the key column is kept (the reference drops it)."""
    df, fit_rows = _cleaned(df, cfg or RunConfig())
    medians, cats = clean.fit_medians(fit_rows), clean.fit_categories(fit_rows)
    return clean.apply_one_hot(clean.apply_fill(df, medians), cats), cats, medians


def feature_table(df: DataFrame, cfg: RunConfig | None = None):
    """B1-B4 + C6: returns (df, feature column order, created, categories, medians, feature medians, rows to fit on).

    Two fits: medians of the input columns with the categories, then medians of the
    created columns, whose inputs the first settles."""
    cfg = cfg or RunConfig()
    df, fit_rows = _cleaned(df, cfg)
    medians = stats.exact_medians(fit_rows, [c for c in MEDIAN_FILL if c in df.columns])
    cats = clean.fit_categories(fit_rows, [c for c in CATEGORICAL if c in df.columns])

    def encode(rows: DataFrame):
        return features.add_features(clean.apply_one_hot(clean.apply_fill(rows, medians), cats), cfg.feature_types)

    out, created = encode(df)
    # the medians of the created columns, the correlations and the scaler read this table
    wide = write_shared(out, "features")
    seen = wide if cfg.fit_on == "all" else write_shared(encode(fit_rows)[0], "features-train")
    fmed = stats.exact_medians(seen, created)
    wide, seen = clean.apply_fill(wide, fmed), clean.apply_fill(seen, fmed)
    feats = [c for c in wide.columns if c not in (cfg.key, cfg.target)]
    return wide, feats, created, cats, medians, fmed, seen


def prepare(df: DataFrame, cfg: RunConfig | None = None) -> Prepared:
    """B1-B4, C6 and D1/D2 pruning of any attempt table (fitted on all rows by default, S10)."""
    cfg = cfg or RunConfig()
    wide, feats, created, cats, medians, fmed, seen = feature_table(df, cfg)
    drop = stats.correlation_drop_list(stats.correlation_pairs(seen, feats), feats)
    kept = [c for c in feats if c not in drop]
    return Prepared(wide.select(cfg.key, *kept, cfg.target), kept, [c for c in created if c in kept], drop, cats, medians, fmed)


@dataclass
class SplitData:
    rows: DataFrame  # all rows, scaled, with ``split``
    features: list[str]
    scaler: dict

    @property
    def train(self) -> DataFrame:
        return self.rows.where(F.col("split") == "train").drop("split")

    @property
    def test(self) -> DataFrame:
        return self.rows.where(F.col("split") == "test").drop("split")


def split_and_scale(prep: Prepared, cfg: RunConfig | None = None) -> SplitData:
    """E1 stratified split, then D8 scaler fitted on train and applied to both: one aggregate over the rows of train
    fits the scaler, one projection scales all. The split is a column over the rows as ``prepare`` wrote them: a second
    wide copy would cost more than both reads. Boolean dummies become 0/1 doubles."""
    cfg = cfg or RunConfig()
    data = prep.data.withColumns({c: F.col(c).cast("double") for c in prep.features})
    tagged = sampling.stratified_split(data, cfg.key, cfg.target, cfg.test_size, cfg.seed, stratify=cfg.stratify)
    params = stats.fit_standard_scaler(tagged.where(F.col("split") == "train"), prep.features)
    return SplitData(stats.apply_standard_scaler(tagged, params), prep.features, params)
