"""Connected components of an undirected graph, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.sources.shared import discard, settle


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), where root is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends and contracts the edges, so the number of
    rounds grows with the logarithm of the component sizes. A node with very many edges is reduced on the map side; joins on it are
    left to adaptive execution, which splits them."""
    edges = settle(edges.select("a", "b").where("a <> b").distinct())
    found = settle(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).withColumnRenamed("a", "n")
        hooks = settle(hooks)
        while True:  # p of p, until all hooks end at a root
            up = hooks.select("n", "p")
            above = up.select(F.col("n").alias("m"), F.col("p").alias("q"))
            jumped = settle(up.join(above, up["p"] == above["m"]).select("n", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
            discard(hooks)
            hooks = jumped
            if jumped.where("moved").isEmpty():
                break
        up = hooks.select("n", "p")
        named = settle(found.join(up, found["root"] == up["n"], "left").select("node", F.coalesce("p", "root").alias("root")))
        left, right = up.select(F.col("n").alias("a"), F.col("p").alias("pa")), up.select(F.col("n").alias("b"), F.col("p").alias("pb"))
        fewer = settle(edges.join(left, "a").join(right, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
        discard(found, edges, hooks)  # what the next round does not read
        found, edges = named, fewer
    discard(edges)
    return found
