"""Session helpers: a local session for tests and a durable place to cut lineage."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session as the tests and the benchmark use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; set an own one only where none is named.

    A machine-local folder is only ever taken in local mode.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="quern-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of df into the shared checkpoint folder, so that several readers reuse it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files and checkpoints of tables that nothing refers to any more.

    It does so when the driver collects its garbage, which may be long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
