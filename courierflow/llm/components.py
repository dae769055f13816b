"""Connected components by alternating large-star and small-star rounds.

Each round points every node's neighbours at the smallest node it knows.  A
round is two grouped minima (reduced map-side) and two equi-joins; its edges are
written to the shared folder.  Rounds go on until every node points at a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierflow.llm.common import written


def _stars(edges: DataFrame) -> bool:
    """Whether every node points at one root and no root points on: then the
    stars are the components."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out")).unionByName(edges.select(F.col("b").alias("node"), F.lit(None).cast("int").alias("out")))
    uses = ends.groupBy("node").agg(F.count("out").alias("outs"), F.count(F.lit(1)).alias("all"))
    return uses.where("outs > 1 OR (outs = 1 AND all > 1)").isEmpty()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every greater neighbour of a node gets the least of the node and its neighbours.
    Small: the node and its smaller neighbours get the least of them."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # written, so that the join below has exchanges of its own and a hub's rows can be split
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "links-least")
    seen = both.join(least, F.col("u") == F.col("w"))
    if large:
        out = seen.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = seen.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b); the root is the component's smallest node."""
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _stars(now):
        now = written(_star(written(_star(now, True), "links"), False), "links")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
