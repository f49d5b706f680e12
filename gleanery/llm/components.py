"""Connected components of a large graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import textkit as tk


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a > b), written. Large: every neighbour above a node moves to the node's least neighbour; small: those below."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = tk.written(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))  # written, so that the join can split a hub's edges
    met = both.join(least.hint("merge"), "a")
    moved = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = tk.written(moved.filter("a <> b").distinct())
    tk.discard(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that edges reach) of every node on an edge `a`, `b`.

    Each round is written to the shared folder; rounds stop when the edges no longer
    change, after some log of the number of nodes. Loops and repeated edges do no harm.
    """
    edges = tk.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if state == seen:
            break
        seen = state
        halfway = _star(edges, True)
        after = _star(halfway, False)
        tk.discard(edges, halfway)
        edges = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
