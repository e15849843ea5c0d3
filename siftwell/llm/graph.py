"""Connected components by hooking and contraction, all in joins.

Each round hooks every node to its smallest neighbour, shortens the chains by
pointer jumping, and contracts the edges to the roots that are left. Every
round is written to the shared folder; nothing is collected. A component ends
under its smallest node. Most nodes of a star share a parent, and a hub most
edges: joins on either go through ``spread_join``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import spread_join, written


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) -> (node, root), one row per node that has an edge;
    root is the smallest node reachable. Loops and repeated edges are allowed."""
    edges = written(edges.select("u", "v").filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    labels = None
    while edges.head(1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = written(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "cc-hooks")
        while True:
            up = hook.select(F.col("u").alias("p"), F.col("p").alias("q"))
            hook = written(spread_join(hook, up, "p", "u").select("u", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "cc-jumps")
            if not hook.filter("moved").head(1):
                hook = hook.select("u", "p")
                break
            hook = hook.select("u", "p")
        if labels is None:
            labels = hook.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            step = hook.select(F.col("u").alias("root"), "p")
            labels = written(spread_join(labels, step, "root", "node", "left").select("node", F.coalesce("p", "root").alias("root")), "cc-labels")
        a = written(spread_join(edges, hook, "u", "v").select(F.col("p").alias("u"), "v"), "cc-half")
        b = spread_join(a, hook.select(F.col("u").alias("v"), "p"), "v", "u").select("u", F.col("p").alias("v"))
        edges = written(b.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels
