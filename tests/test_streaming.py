"""The fitted preparation applies unchanged to a streaming source."""

import os
import uuid

from pyspark.sql import functions as F

from dialsift.plans import prepare
from dialsift.sources.attempts import attempts
from dialsift.streaming.scoring import from_prepared, transform

from .conftest import SF001


def test_stream_equals_batch(spark):
    prep = prepare.prepare(attempts(spark, SF001))
    params = {c: (0.0, 1.0) for c in prep.features}
    fp = from_prepared(prep, params)
    base = os.path.join(spark.sparkContext.getCheckpointDir(), f"stream-{uuid.uuid4().hex}")
    src = attempts(spark, SF001)
    src.write.parquet(f"{base}/src")
    batch = transform(spark.read.parquet(f"{base}/src"), fp)
    stream = transform(spark.readStream.schema(src.schema).parquet(f"{base}/src"), fp)
    q = stream.writeStream.format("memory").queryName("prep_stream").option(
        "checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("prep_stream")
    assert got.count() == batch.count() == src.count()
    diff = got.select("CODIGO", F.round(F.col(prep.features[-1]), 6).alias("v")).exceptAll(
        batch.select("CODIGO", F.round(F.col(prep.features[-1]), 6).alias("v")))
    assert diff.count() == 0


def test_stream_scores_equal_batch_scores(spark):
    """A fitted zoo model scores a stream of attempts per micro-batch as it scores the table."""
    from dialsift.models.registry import BY_NAME, FitContext
    from dialsift.models.runner import to_ml
    from dialsift.streaming.scoring import stream_scores

    src = attempts(spark, SF001)
    prep = prepare.prepare(src)
    params = {c: (0.0, 1.0) for c in prep.features}
    fp = from_prepared(prep, params)
    base = os.path.join(spark.sparkContext.getCheckpointDir(), f"scores-{uuid.uuid4().hex}")
    src.write.parquet(f"{base}/src")
    rows = transform(spark.read.parquet(f"{base}/src"), fp).na.fill(0.0)
    arrays = rows.select(F.col("CODIGO").alias("key"), (F.col("CODIGO") % 2).alias("y"), F.array(*prep.features).alias("vec"))
    model = BY_NAME["Linear_RidgeClassifier"].build(FitContext(100, len(prep.features), 1.0))(to_ml(arrays))
    expected = {r["key"]: round(r["score"], 6) for r in model.transform(to_ml(arrays)).select("key", "score").collect()}
    got = {}
    stream_scores(spark, f"{base}/src", src.schema, fp, model,
                  lambda df, _: got.update({r["CODIGO"]: round(r["score"], 6) for r in df.select("CODIGO", "score").collect()}),
                  f"{base}/ckpt").awaitTermination()
    assert got == expected and len(got) == src.count()
