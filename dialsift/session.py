"""SparkSession helpers: one place for the settings every job relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "dialsift", shuffle_partitions: int | None = None) -> SparkSession:
    """Create (or reuse) a session with AQE, skew-join splitting and no UI."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("DIALSIFT_DRIVER_MEMORY", "16g"))
        # checkpoint files of slice ranks and fitted tables go away once unused
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", os.environ.get("DIALSIFT_CLEAN_CHECKPOINTS", "true"))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    tune_session(spark)
    return spark


def tune_session(spark: SparkSession) -> None:
    """Runtime SQL settings the wide projections rely on; a value the user
    set explicitly is kept.

    The feature projection (34 guarded divisions, logs and row sums) compiles
    into one whole-stage method bigger than the 8000 bytes HotSpot will JIT,
    so it would run interpreted (5x slower, measured). With the limit at 8000
    Spark detects such a stage and runs it with per-expression codegen."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # documents are kilobytes each: Arrow batches of 10000 rows would be tens of MB in the JVM and in Python
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``. Where it is unset, a ``local``
    master gets a fresh scratch folder and a cluster an error: its executors do
    not share the driver's folders."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="dialsift-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


_WRITTEN: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint directory; removed at the end of the driver."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def is_shared(path: str) -> bool:
    """Was ``path`` handed out by ``shared_path`` and not released since?"""
    return path in _WRITTEN


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back: evaluated
    once, lineage cut (a lost executor re-reads files), columns prunable and sizes known to
    the plans that follow."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def release_shared() -> None:
    """Delete the intermediate tables of this driver. DataFrames that read them end with it; a long
    session may call this between jobs."""
    sc = SparkContext._active_spark_context
    while sc is not None and _WRITTEN:
        try:
            path = sc._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df`` (0 when it has none)."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # noqa: BLE001 - an estimate only
        return 0


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors (once for each application) and
    settle the session's SQL settings."""
    tune_session(spark)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(here):  # a package that already comes out of an archive was shipped as one
        base = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="dialsift-ship-")), "dialsift")
        sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
    _SHIPPED.add(sc.applicationId)
