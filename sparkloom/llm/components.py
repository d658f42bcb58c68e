"""Connected components of a graph held as a DataFrame, by alternating large and small stars.

In a large star each node's larger neighbours are tied to its smallest
neighbour, in a small star its smaller ones; the edges become stars around each
component's smallest node in a number of rounds that grows with the logarithm
of the nodes.  Minima are taken with partial aggregation and edges are only
joined by node, so a node of any degree is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import durable, sized


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(low.select("u", F.col("m").alias("v")))


def partly(edges: DataFrame) -> DataFrame:
    """(node, label) at the price of one aggregation: nodes of one label are connected, but a component can have several labels."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    low = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "nearest")
    up = sized(low).toDF("m", "top")
    out = low
    for _ in range(2):
        out = out.join(up, "m", "left").select("u", F.coalesce("top", "m").alias("m"))
    return durable(out.toDF("node", "label"), "labels")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (u, v): label is the smallest node of its component."""
    edges = durable(edges.select("u", "v").distinct(), "edges")
    near = partly(edges)
    # what is left are edges between labels; the labels of a component are connected by them, its smallest node is one
    to = sized(near)
    e = edges.join(to.toDF("u", "a"), "u").join(to.toDF("v", "b"), "v").filter("a <> b")
    e = durable(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "label-edges")
    while True:
        # done when every node has one edge, and none to a node that has an edge itself
        several = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
        middle = e.select("u").join(e.select(F.col("v").alias("u")), "u", "left_semi")
        if not several.union(middle).limit(1).count():
            break
        e = durable(_small_star(_large_star(e)).distinct(), "stars")
    return durable(near.join(sized(e).toDF("label", "top"), "label", "left").select("node", F.coalesce("top", "label").alias("label")), "components")
