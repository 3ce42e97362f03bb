"""Connected components of links between integer nodes, by repeated contraction.

Every round lets each node point at the smallest of itself and its neighbours,
shortens those pointers, and replaces the links by links between what they
point at.  Links between the same nodes meet in one, so the table shrinks every
round; what remains of a component in the end is its smallest node.  All joins
are of tables, so that AQE can split a node that many others point at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(links: DataFrame, ws: Workspace, name: str = "components") -> DataFrame:
    """links: (a, b).  Returns (node, component) for each node that has a link; component is its smallest node."""
    links = ws.save(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-links0")
    maps, k = [], 0
    while not links.isEmpty():
        ends = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = ends.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("to"))
        to = ws.save(to, f"{name}-near{k}")
        for hop in range(2):
            after = to.select(F.col("node").alias("to"), F.col("to").alias("after"))
            to = ws.save(to.join(after, "to").select("node", F.col("after").alias("to")), f"{name}-hop{k}-{hop}")
        maps.append(to)
        low = to.select(F.col("node").alias("a"), F.col("to").alias("x"))
        high = to.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = links.join(low, "a").join(high, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        links = ws.save(moved, f"{name}-links{k + 1}")
        ws.drop(f"{name}-links{k}", f"{name}-near{k}", f"{name}-hop{k}-0")
        k += 1
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0].withColumnRenamed("to", "component")
    for later in maps[1:]:
        step = later.select(F.col("node").alias("component"), F.col("to").alias("next"))
        out = out.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return ws.save(out, f"{name}-out")
