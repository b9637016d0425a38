"""Connected components of an edge table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweaver.session import cut


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node of the edges (a > b, each once) has one smaller neighbour or only larger ones: then the edges are the components."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of ``edges`` (a, b: long) the smallest node it reaches.

    Alternates large-star and small-star rounds until the edges are stars around the smallest
    node. Neighbourhoods are only aggregated to their minimum, which is written and joined back, so
    both sides of that join are plain shuffles: a star centre with very many leaves is a skewed
    join, which adaptive execution splits, and never a group held by one task. Each round is checkpointed. Null ends and loops are ignored; an empty table
    has no components.
    """
    e = cut(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for done in range(max_rounds + 1):
        if _are_stars(e):  # no round is run only to see that nothing changes
            break
        if done == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        # large star: link each larger neighbour to the smallest neighbour
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        e = cut(both.join(low, "a").filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: link the smaller neighbours, and the node itself, to the smallest of them
        low = cut(e.groupBy("a").agg(F.min("b").alias("m")))
        e = e.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        e = cut(e.select("x.*").filter("a <> b").distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
