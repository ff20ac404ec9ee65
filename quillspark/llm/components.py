"""Connected components of a distributed edge list, each named by its smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> node, root; only nodes of edges. Labels take the least of their neighbours' and then their label's
    label, so a chain of n nodes takes about log n rounds. Each round is written to the shared folder."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        taken = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        above = taken.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = stored(taken.join(above, "root").select("node", F.least("root", "top").alias("root"), "old"))
        if new.where("root <> old").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")
