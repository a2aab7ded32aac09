"""Connected components as a loop of joins over contracted edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every end of an edge; the component is its smallest node.

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots by
    pointer jumping, and contracts the edges onto the roots; the number of edges shrinks at least
    by half a round. Sums are partial and the joins have one row a key on one side, so a node with
    very many neighbours is no bottleneck. Null ends and self-loops are left out.
    """
    live = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct(), "cc-edges")
    found: DataFrame | None = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).withColumnRenamed("a", "node"), "cc-hooks")
        while True:
            up = hook.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            nxt = materialize(hook.join(up, "p").select("node", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "cc-jump")
            hook = nxt.drop("moved")
            if nxt.where("moved").isEmpty():
                break
        if found is None:
            found = hook.select("node", F.col("p").alias("component"))
        else:
            top = hook.select(F.col("node").alias("component"), F.col("p").alias("root"))
            found = materialize(found.join(top, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "cc-found")
        ra, rb = hook.select(F.col("node").alias("a"), F.col("p").alias("pa")), hook.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        live = materialize(live.join(ra, "a").join(rb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
    if found is None:
        kind = edges.schema[a].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    return found
