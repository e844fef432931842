"""Classification metrics for any number of runs at once.

Input: a table with a run column, the score, the 0/1 label and the 0/1
prediction. Counts are one partial+final aggregate keyed by run. ROC-AUC and
average precision group rows by (run, score) first (ties handled exactly),
then need running sums over the scores in order: :func:`running_totals`, so no
run is ever held by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import running_totals


def _ratio0(num, den):
    """num/den, 0.0 when den is 0 (sklearn zero_division=0, S17)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def classification_metrics(df: DataFrame, run_cols: Sequence[str] = ("run",), label: str = "y",
                           pred: str = "pred") -> DataFrame:
    """precision, recall, f1 of class 1 per run (G1)."""
    y, p = F.col(label), F.col(pred)
    c = df.groupBy(*run_cols).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    )
    prec = _ratio0(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _ratio0(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = _ratio0(F.lit(2) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn"))
    return c.select(*run_cols, prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def _score_groups(df: DataFrame, run_cols, score: str, label: str) -> DataFrame:
    return df.groupBy(*run_cols, F.col(score).alias("_s")).agg(
        F.sum(F.col(label).cast("bigint")).alias("_pos"),
        F.sum((F.lit(1) - F.col(label)).cast("bigint")).alias("_neg"),
    )


def ranking_metrics(df: DataFrame, run_cols: Sequence[str] = ("run",), score: str = "score", label: str = "y") -> DataFrame:
    """roc_auc and pr_auc per run from one pass in descending score order.

    ROC-AUC is tie-aware (Mann-Whitney U / (P·N)), NULL when a run has only one
    class (G2); average precision is Σ over distinct scores of (ΔR)·P, NULL
    without positives (G3)."""
    runs = list(run_cols)
    cum = running_totals(_score_groups(df, runs, score, label), [F.col("_s").desc()], runs,
                         sums={"_cpos": F.col("_pos"), "_cneg": F.col("_neg")}, rank_col="_r", totals_prefix="_t")
    pos, neg = F.col("_pos").cast("double"), F.col("_neg").cast("double")
    below = (F.col("_t_cneg") - F.col("_cneg")).cast("double")  # negatives with a smaller score
    agg = cum.groupBy(*runs).agg(
        F.sum(pos * below + F.lit(0.5) * pos * neg).alias("_u"),
        F.sum(pos * (F.col("_cpos").cast("double") / (F.col("_cpos") + F.col("_cneg")).cast("double"))).alias("_a"),
        F.sum(pos).alias("_p"), F.sum(neg).alias("_n"),
    )
    return agg.select(
        *runs,
        F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.try_divide(F.col("_u"), F.col("_p") * F.col("_n"))).alias("roc_auc"),
        F.try_divide(F.col("_a"), F.col("_p")).alias("pr_auc"),
    )


def roc_auc(df: DataFrame, run_cols: Sequence[str] = ("run",), score: str = "score", label: str = "y") -> DataFrame:
    return ranking_metrics(df, run_cols, score, label).drop("pr_auc")


def average_precision(df: DataFrame, run_cols: Sequence[str] = ("run",), score: str = "score", label: str = "y") -> DataFrame:
    return ranking_metrics(df, run_cols, score, label).drop("roc_auc")


def recall_with_min_precision(metrics: DataFrame, min_precision: float = 0.15) -> DataFrame:
    """recall if precision >= min, else recall - 2·(min - precision)."""
    p, r = F.col("precision"), F.col("recall")
    return metrics.withColumn(
        "recall_min_precision",
        F.when(p >= F.lit(min_precision), r).otherwise(r - (F.lit(min_precision) - p) * F.lit(2.0)),
    )


def all_metrics(df: DataFrame, run_cols: Sequence[str] = ("run",), score: str = "score", label: str = "y",
                pred: str = "pred") -> DataFrame:
    """precision, recall, f1, roc_auc, pr_auc per run in one table."""
    runs = list(run_cols)
    return classification_metrics(df, runs, label, pred).join(ranking_metrics(df, runs, score, label), runs, "left")
