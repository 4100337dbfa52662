"""Connected components of an edge table by repeated contraction.

Each round hooks every node to its smallest neighbour, follows the hooks twice, and
replaces edges by edges between the new roots. Edges only shrink; a round is a few
aggregates and equi-joins, and its result is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (columns a, b); component is the
    smallest node reachable. Loops and repeated edges are allowed."""
    links = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels = None
    for _ in range(max_rounds):
        both = links.select(F.col("b").alias("node"), F.col("a").alias("to")).unionByName(links.select(F.col("a").alias("node"), F.col("b").alias("to")))
        hook = materialize(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("up")), "cc-hook")
        for _ in range(2):
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hook = hook.join(above, "up").select("node", F.col("top").alias("up"))
        hook = materialize(hook, "cc-up")
        if labels is None:
            labels = hook.select("node", F.col("up").alias("component"))
        else:
            up = hook.select(F.col("node").alias("component"), F.col("up").alias("top"))
            labels = materialize(labels.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "cc-labels")
        a, b = hook.select(F.col("node").alias("a"), F.col("up").alias("ra")), hook.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        links = links.join(a, "a").join(b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        links = materialize(links, "cc-edges")
        if links.isEmpty():
            return labels
    raise RuntimeError(f"components did not close in {max_rounds} rounds")
