"""Table sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; columns are pruned by the plan that reads it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over the cores by a key where the input has far fewer splits than the cluster has cores.

    A large table has more splits than cores and is left as it is, so this
    moves small inputs only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() * 2 <= cores else df


def balanced(df: DataFrame, key: str) -> DataFrame:
    """Rows over all tasks by a key, for costly work on rows that are small: their number, not their size, counts.

    The number of partitions is fixed, so that small ones aren't merged.
    """
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, key)
