"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldqueue.llm.shared import kept


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b: long): the smallest node that it reaches.

    Each round hangs a node's larger neighbours, then its smaller ones, on its smallest neighbour; the number
    of rounds grows with the logarithm of the longest path. Neighbours are never gathered: a round takes
    minima and joins, both of which split a node with very many edges. Each round's edges are written out, and
    the loop ends once no edge has changed.
    """
    e = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(down, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        e = kept(small.unionByName(down.select("a", F.col("low").alias("b"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
