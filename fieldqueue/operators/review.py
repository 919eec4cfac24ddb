"""Consensus answers held against first identifications, and experiments re-randomised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse_refinements(public: DataFrame, firsts: DataFrame, lineage: DataFrame) -> DataFrame:
    """(id, taxon): the public taxon, or the first one where the public taxon descends from it."""
    j = public.join(firsts.withColumnRenamed("taxon", "first"), "id", "left").join(lineage.withColumnsRenamed({"id": "taxon"}), "taxon", "left")
    return j.select("id", F.when(F.array_contains("path", F.col("first")), F.col("first")).otherwise(F.col("taxon")).alias("taxon"))


def roll_up(candidates: DataFrame, lineage: DataFrame, threshold: float) -> DataFrame:
    """(record, taxon, p): the deepest taxon that gathers so much probability at or below it, from rows (record, taxon, p)."""
    x = candidates.join(lineage.withColumnsRenamed({"id": "taxon"}), "taxon").select("record", "p", F.posexplode("path").alias("depth", "node"))
    s = x.groupBy("record", "depth", "node").agg(F.sum("p").alias("p")).where(F.col("p") >= threshold - 1e-9)
    return s.groupBy("record").agg(F.max(F.struct("depth", "p", "node")).alias("b")).select("record", F.col("b.node").alias("taxon"), F.col("b.p").alias("p"))


def missing_ancestors(nodes: DataFrame) -> DataFrame:
    """(id): parents that are no node themselves."""
    return nodes.where("parent is not null").select(F.col("parent").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")


def hard_cases(consensus: DataFrame, firsts: DataFrame, threshold: float) -> DataFrame:
    """(record, why): settled against the first answer, or not settled."""
    j = consensus.join(firsts, "record", "left")
    why = F.when(F.col("posterior") < threshold, "unsettled").when(F.col("label") != F.col("first"), "overturned")
    return j.select("record", why.alias("why")).where("why is not null")


def detection(consensus: DataFrame, firsts: DataFrame, public: DataFrame, threshold: float, c: float) -> DataFrame:
    """One row a source: settled records, share that the consensus finds wrong freed from its own error c, share that the public overturned, and their ratio."""
    j = consensus.where(F.col("posterior") >= threshold).join(firsts, "record").join(public, "record")
    wrong = F.avg((F.col("label") != F.col("first")).cast("double"))
    over = F.avg((F.col("public") != F.col("first")).cast("double"))
    fixed = F.least(F.greatest((wrong - c) / (1 - 2 * c), F.lit(0.0)), F.lit(1.0))
    g = j.groupBy("source").agg(F.count("*").alias("n"), fixed.alias("error"), over.alias("overturned"))
    return g.withColumn("detected", F.least(F.lit(1.0), F.try_divide("overturned", "error")))


def spans(nodes_with_paths: DataFrame) -> DataFrame:
    """(id, lo, hi): places of the leaves below each node in the order of their paths, from rows (id, path).

    Leaves are numbered by a range of their first step and a window within it.
    """
    inner = nodes_with_paths.select(F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("id")).distinct()
    leaves = nodes_with_paths.join(inner, "id", "left_anti").withColumn("_text", F.array_join("path", "/")).withColumn("_root", F.get("path", F.lit(0)))
    n = leaves.groupBy("_root").agg(F.count("*").alias("_n"))
    n = n.select("_root", (F.sum("_n").over(Window.orderBy("_root")) - F.col("_n")).alias("_base"))
    at = leaves.join(n, "_root").select("path", (F.col("_base") + F.row_number().over(Window.partitionBy("_root").orderBy("_text")) - 1).alias("at"))
    return at.select(F.explode("path").alias("id"), "at").groupBy("id").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))


def value_rounds(df: DataFrame, by: str, tier: Column, rarity: Column, size: int) -> DataFrame:
    """Adds `place`: rows of a tier first, in rounds of so many of each tier, the rare before the common; then the rest in their order."""
    d = df.withColumn("_t", tier).withColumn("_r", rarity)
    k = F.row_number().over(Window.partitionBy(by, "_t").orderBy("_r", "id"))
    order = [F.col("_t").isNull().asc(), F.col("_t").asc(), F.col("_round").asc(), F.col("_r").asc(), F.col("id").asc()]
    d = d.withColumn("_round", F.floor((k - 1) / size))
    return d.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).drop("_t", "_r", "_round")
