"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation and one join on node ids; a node's neighbours are never gathered (the
minimum is combined before the shuffle, and the join divides the edges of a node that has very many), so a node with
a third of all edges is no hot task. Edges are written to the shared folder between the steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..storage import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each neighbour (the larger ones, or the smaller ones and the node itself) to the least of node and neighbours."""
    if large:
        nb = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    else:
        nb = edges.select(F.greatest("u", "v").alias("n"), F.least("u", "v").alias("m"))
    least = nb.groupBy("n").agg(F.least("n", F.min("m")).alias("least"), F.count("*").alias("edges"))
    out = spread_join(nb, least, ["n"], by=["m"], count="edges")
    if large:
        out = out.filter("m > n").select(F.col("least").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("least").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("least").alias("u"), F.col("n").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of an edge list of two columns; component is the smallest node.

    Null ends and loops are ignored (a node with loops only isn't listed). Empty edges: an empty result. The
    rounds go on until nothing changes; their number grows with the logarithm of the longest chain.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    e = staged(e, "edges")
    mark = None
    while True:
        e = staged(_star(_star(e, True), False), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            comp = e.select(F.col("v").alias("node"), F.col("u").alias("component"))
            return comp.unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
        mark = now
