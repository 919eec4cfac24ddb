"""Trees of names: lineages as arrays from the root, and what is counted along them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldqueue.sources.shared import kept


def lineages(nodes: DataFrame) -> DataFrame:
    """(id, path): every node's path from its root, from rows (id, parent). Each round adds one level and is written out, until none is left; nodes of a ring have no root and no path."""
    edge = kept(nodes.where("parent is null").select("id", F.array("id").alias("path")))
    rounds = [edge]
    while True:
        edge = kept(nodes.alias("n").join(edge.alias("e"), F.col("n.parent") == F.col("e.id")).select("n.id", F.concat("e.path", F.array("n.id")).alias("path")))
        if edge.isEmpty():
            return reduce(DataFrame.unionByName, rounds)
        rounds.append(edge)


def relation(then: Column, now: Column) -> Column:
    """How a lineage has changed: same, refined, coarsened, corrected, or none where either is missing."""
    a, b = F.size(then), F.size(now)
    return (
        F.when(then.isNull() | now.isNull(), "none")
        .when(then == now, "same")
        .when((a < b) & (F.slice(now, F.lit(1), a) == then), "refined")
        .when((a > b) & (F.slice(then, F.lit(1), b) == now), "coarsened")
        .otherwise("corrected")
    )


def common_depth(a: Column, b: Column) -> Column:
    """Length of the common beginning of two lineages."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def counts_below(records: DataFrame) -> DataFrame:
    """(node, own, below, deepest): records at each node of their paths, and at or below it."""
    x = records.select(F.posexplode("path").alias("depth", "node"), F.size("path").alias("n"))
    return x.groupBy("node").agg(F.count_if(F.col("depth") == F.col("n") - 1).alias("own"), F.count("*").alias("below"), F.max(F.col("n") - 1 - F.col("depth")).cast("int").alias("deepest"))


def community(votes: DataFrame) -> DataFrame:
    """(id, node, score): the deepest node that two or more votes are at or below, and more than two thirds of those for or against it.

    A vote is against a node unless it is at or below it or for one of its ancestors. Rows (id, path).
    """
    x = votes.select("id", F.posexplode("path").alias("depth", "node"), "path")
    at = x.groupBy("id", "node").agg(F.count("*").alias("n"), F.min("depth").alias("depth"), F.min(F.slice("path", F.lit(1), F.col("depth"))).alias("above"))
    leaf = votes.groupBy("id", F.element_at("path", -1).alias("leaf")).agg(F.count("*").alias("k"))
    all_ = votes.groupBy("id").agg(F.count("*").alias("votes"))
    aside = at.select("id", "node", F.explode("above").alias("leaf")).join(leaf, ["id", "leaf"]).groupBy("id", "node").agg(F.sum("k").alias("aside"))
    fit = at.join(all_, "id").join(aside, ["id", "node"], "left").withColumn("counted", F.col("votes") - F.coalesce("aside", F.lit(0)))
    fit = fit.where((F.col("n") >= 2) & (3 * F.col("n") > 2 * F.col("counted")))
    best = fit.groupBy("id").agg(F.max(F.struct("depth", "node", "n", "counted")).alias("b"))
    return best.select("id", "b.node", (F.col("b.n") / F.col("b.counted")).alias("score"))


def unambiguous(names: DataFrame) -> DataFrame:
    """(name, slug): names that one slug has, or that are some slug's own name."""
    by = names.groupBy("name").agg(F.count_distinct("slug").alias("slugs"), F.min("slug").alias("slug"), F.min(F.when(F.col("own"), F.col("slug"))).alias("owner"))
    return by.select("name", F.when(F.col("slugs") == 1, F.col("slug")).otherwise(F.col("owner")).alias("slug")).where("slug is not null")


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, role, partner, n, place): partners on either side of a relation, commonest first."""
    e = edges.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    both = e.select(F.col("a").alias("node"), F.lit("out").alias("role"), F.col("b").alias("partner"), "n").unionByName(e.select(F.col("b").alias("node"), F.lit("in").alias("role"), F.col("a").alias("partner"), "n"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("node", "role").orderBy(F.col("n").desc(), "partner")))
