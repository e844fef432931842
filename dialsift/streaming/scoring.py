"""Scoring new attempts as they arrive (Structured Streaming).

The reference has no streams. What carries over is that every transform
after fitting is a stateless column expression: category and median fills,
drop-first dummies, the 34 derived features, the median fill of created
columns, the kept-column projection and the standard scaler. A
:class:`FittedPrep` holds those fitted values, and :func:`transform` applies
them to a batch *or* a streaming DataFrame alike, so the same plan scores a
``readStream`` of new attempt files. Model scoring runs per micro-batch in
``foreachBatch`` (Spark ML models are batch transformers).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, features, stats
from ..plans.prepare import Prepared


@dataclass
class FittedPrep:
    key: str
    categories: dict[str, list[str]]
    medians: dict[str, float | None]
    feature_medians: dict[str, float | None]
    features: list[str]
    scaler: dict[str, tuple[float, float]]


def from_prepared(prep: Prepared, scaler: dict[str, tuple[float, float]], key: str = "CODIGO") -> FittedPrep:
    return FittedPrep(key, prep.categories, prep.medians, prep.feature_medians, prep.features, scaler)


def transform(df: DataFrame, fp: FittedPrep) -> DataFrame:
    """Fitted preparation as pure projections (batch or streaming input)."""
    out = clean.fill_category(clean.drop_columns(df, keep=[fp.key]))
    out = clean.apply_fill(out, fp.medians)
    out = clean.apply_one_hot(out, fp.categories)
    out, _ = features.add_features(out)
    out = clean.apply_fill(out, fp.feature_medians)
    out = out.select(fp.key, *[F.col(c).cast("double").alias(c) for c in fp.features])
    return stats.apply_standard_scaler(out, {c: fp.scaler[c] for c in fp.features if c in fp.scaler})


def stream_scores(spark: SparkSession, source_dir: str, schema, fp: FittedPrep, model,
                  on_batch: Callable[[DataFrame, int], None], checkpoint_dir: str, trigger_once: bool = True):
    """readStream parquet attempts -> prepared features -> ``model`` scores ->
    ``on_batch(scored_df, epoch_id)``. Returns the started query."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    prepared = transform(stream, fp).na.fill(0.0)
    assembler = VectorAssembler(inputCols=fp.features, outputCol="features")

    def batch(bdf: DataFrame, epoch: int) -> None:
        on_batch(model.transform(assembler.transform(bdf)), epoch)

    writer = prepared.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_dir)
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
