"""Order statistics over whole tables without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.session import durable


def positions(counts: DataFrame, value: str, n: str, by: list[str]) -> DataFrame:
    """Adds `before`, the number of rows of smaller values of the same group, to (by.., value, n) of distinct values.

    Values are cut into ranges over the tasks; each range is summed on its own
    and shifted by the sums of the ranges before it, one row a range and group.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = durable(counts.repartitionByRange(parts, *by, value).withColumn("_part", F.spark_partition_id()))
    sums = cut.groupBy(*by, "_part").agg(F.sum(n).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.withColumn("_shift", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(F.broadcast(shift), [*by, "_part"])  # a row per range and group
    return rows.withColumn("before", F.col("_inside") + F.col("_shift")).drop("_inside", "_shift", "_part")


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """(by.., n, mean, one column per share): of each group the value at place floor(n * share) from 0 in order.

    Nulls are left out; groups without a value have no row.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    total = counts.groupBy(*by).agg(F.sum("_n").alias("n"), (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("mean"))
    placed = positions(counts, value, "_n", by).join(total, by)
    hit = lambda s: F.max(F.when((F.col("before") <= F.floor(F.col("n") * s)) & (F.floor(F.col("n") * s) < F.col("before") + F.col("_n")), F.col(value)))
    return placed.groupBy(*by).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), *[hit(s).alias(k) for k, s in shares.items()])
