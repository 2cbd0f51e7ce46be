"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum and an equi-join on the node; hub nodes are pre-aggregated before
the shuffle and the join side may be split by adaptive execution. Steps are written to the shared
folder, so that lineage stays short and lost executors cost one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b), a > b. Large: a node's larger neighbours point to its least neighbour; small: its smaller ones do."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        # (b, m) for neighbours b > a; those are the rows of edges, seen from their smaller end
        out = edges.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node reachable."""
    tables = Tables(edges.sparkSession)
    now = tables.stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "links")
    seen = None
    while True:
        now = tables.stored(_star(_star(now, True), False), "links")
        tables.clear(now)  # the step before is not read any more
        fresh = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if fresh == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root"))
            ).distinct()
        seen = fresh
