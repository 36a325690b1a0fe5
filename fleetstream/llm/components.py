"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstream.session import stage


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links of longs -> (node, root), root being the smallest node of the component.

    Each step turns links into links to the smallest neighbour: only minima per
    node are gathered, never its list of neighbours, so a node with very many
    links costs one partial aggregate per task. Links are written to the shared
    folder after each round; a lost executor re-reads files. Nodes without a
    link do not appear; links from a node to itself and repeated links are
    ignored; an empty table gives an empty one.
    """
    edges = stage(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _signature(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of a node go to the smallest of its neighbourhood
        large = edges.select(F.col("v").alias("node"), F.col("u").alias("x")).join(least.withColumnRenamed("u", "node"), "node").select(F.col("x").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = stage(small.filter("u != v").distinct(), "links")
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
