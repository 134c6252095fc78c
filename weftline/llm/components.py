"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two small aggregations and joins; tables are written between rounds, so lineage stays
short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import forget, written


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return small.where("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``(a, b)`` edges to ``(node, root)``: each node of a component and the smallest node of it.

    Roots themselves have no row. Order and repeats of edges, and loops, do not matter.
    """
    found = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        following = written(_stars(found), "edges")
        changed = following.join(found, ["a", "b"], "left_anti").limit(1).count() or found.join(following, ["a", "b"], "left_anti").limit(1).count()
        forget(found)  # no later action reads it
        found = following
        if not changed:
            return found.select(F.col("a").alias("node"), F.col("b").alias("root"))
