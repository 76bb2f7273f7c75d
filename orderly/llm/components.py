"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderly.session import materialize, release


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands its neighbours on to the least of them: the larger ones (large) or the smaller ones."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.where("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    out = near.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"), F.col("a").alias("via"))
    if large:
        out = out.where("a > via")
    else:
        out = out.unionByName(least.select("a", F.col("least").alias("b"), F.col("a").alias("via")))
    return out.where("a != b").select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), two columns of one orderable type without nulls: root is the
    least node that it reaches, itself included. Every round is written to the shared folder. Groups are aggregated before they are
    joined, so a star of any size is no single task's work; the rounds grow with the logarithm of the longest chain."""
    current = materialize(edges.select("a", "b").where("a != b").distinct())
    seen = None
    while True:
        before, current = current, materialize(_stars(_stars(current, True), False))
        release(before)
        now = current.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
