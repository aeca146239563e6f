"""Connected components of a link table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import durable


def components(links: DataFrame, a: str, b: str, rounds: int = 50) -> DataFrame:
    """(node, component): of every node in a link the smallest node that it is connected to.

    Labels spread along links and jump to the label of their label; both sides
    are written to the shared checkpoint folder between rounds. Raises if the
    labels still change after `rounds` rounds. No links give no rows.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    edges = durable(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = durable(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.first("x"), F.min("y")).alias("component")))
    for _ in range(rounds):
        near = edges.join(labels, F.col("y") == F.col("node")).groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        spread = labels.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        fresh = durable(spread.join(jump, "low", "left").select("node", "component", F.least("low", F.coalesce("far", "low")).alias("next")))
        if fresh.where(F.col("next") < F.col("component")).limit(1).count() == 0:
            return fresh.select("node", "component")
        labels = fresh.select("node", F.col("next").alias("component"))
    raise RuntimeError("components did not settle")
