"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step hangs nodes below smaller ones until each node points at the smallest of its component. Steps are aggregates
and joins on the node; nothing is gathered on the driver but a count and a checksum of the edges, and each step's edges
are written to the shared folder so that a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.session import drop_path, materialise, workspace

MAX_STEPS = 60


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node that has an edge to another one; root is the component's smallest node.

    Rows: `edges` has columns a and b; repeated edges, both directions and loops are allowed, null ends are ignored."""
    spark, state = edges.sparkSession, None
    current = edges.select("a", "b").filter("a != b")
    former = None
    for step in range(MAX_STEPS):
        path = workspace(spark, f"components-{step}")
        current = materialise(_small(_large(current)), path)
        if former:
            drop_path(spark, former)  # nothing reads the step before any more
        former = path
        n, check = current.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if (n, check) == state or not n:
            return current.select(F.col("a").alias("id"), F.col("b").alias("root"))
        state = (n, check)
    raise RuntimeError(f"no components after {MAX_STEPS} steps")
