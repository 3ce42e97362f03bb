"""Reachability in graphs with long chains.

A search by hops takes as many rounds as the longest path.  Here nodes with one
successor are contracted first by pointer doubling: after k rounds each knows
the node 2**k steps on, or the end of its chain.  The search then goes from
chain end to chain end; what it has seen is only appended to.  At last the
doubled pointers, largest first, mark the nodes inside the chains.  A chain of
n nodes takes some 2 log2(n) rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scans import Save


def jumps(edges: DataFrame, save: Save) -> list[DataFrame]:
    """(node, to) for each node with one successor: table k leads 2**k steps on, or to the end of the chain where that is nearer.

    Nodes on a cycle of such nodes have no end; the tables stop when they lead
    round it.
    """
    first = save(edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("to")).where("n = 1").select(F.col("src").alias("node"), "to"))
    tables, n = [first], first.count()
    while 1 << (len(tables) - 1) < n:
        a, b = tables[-1], tables[-1].select(F.col("node").alias("mid"), F.col("to").alias("far"))
        both = save(a.join(b, a["to"] == b["mid"], "left").select("node", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("open")))
        if both.where("open").isEmpty():
            break
        tables.append(both.select("node", "to"))
    return tables


def follow(nodes: DataFrame, tables: list[DataFrame], save: Save) -> DataFrame:
    """(node): the nodes and all that stand behind them on their chains."""
    for t in reversed(tables):
        nodes = save(nodes.unionByName(nodes.join(t, "node").select(F.col("to").alias("node"))).distinct())
    return nodes


def reachable(roots: DataFrame, edges: DataFrame, save: Save) -> DataFrame:
    """(node) reached from roots (node) over edges (src, dst), the roots included; nulls are no nodes."""
    arcs = save(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    tables = jumps(arcs, save)
    ends = tables[-1]
    forks = arcs.join(tables[0], arcs["src"] == tables[0]["node"], "left_anti")
    frontier = save(roots.select("node").where("node is not null").distinct())
    seen = [frontier]
    while not frontier.isEmpty():
        last = frontier.join(ends, "node", "left").select(F.coalesce("to", "node").alias("node")).distinct()
        new = last.join(forks, last["node"] == forks["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = save(new.join(reduce(DataFrame.unionByName, seen), "node", "left_anti"))
        seen.append(frontier)
    return follow(reduce(DataFrame.unionByName, seen), tables, save)
