"""Gated assembly of a bundle: base vectors, then deltas, published or refused as a whole."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldqueue.operators.vectors import dot
from fieldqueue.sources.shared import kept

#: Share of a group's records that may lack a vector beyond the hours of grace.
MOST_UNCOVERED, GRACE_HOURS = 0.01, 48.0
BUNDLE = ("vectors", "pool", "uncovered")


class Refused(ValueError):
    """A bundle whose vectors are behind."""


@dataclass
class Bundle:
    """Unit vectors (grp, id, origin, v), the pool without the records that lack one, and those (grp, id); a row a group (grp, n, uncovered, late)."""

    vectors: DataFrame
    pool: DataFrame
    uncovered: DataFrame
    groups: DataFrame


def checked(rows: DataFrame, bad: Column, says: Column) -> DataFrame:
    """The rows; reading one that is bad is an error."""
    return rows.withColumn("_bad", F.when(F.coalesce(bad, F.lit(False)), F.raise_error(says).cast("boolean"))).where("_bad is null").drop("_bad")


def covered(pool: DataFrame, base: DataFrame, deltas: DataFrame) -> DataFrame:
    """(grp, id, created_at, origin, new): what the vector of each record of the pool (id, grp, created_at) that has a group comes from, null without one, and whether from a delta.

    base: rows (grp, id, v); a base vector counts in its own group. deltas: rows (name, id, v), for records of any group; of several the one of
    the last name counts, and any before the base's. Only ids go through the joins, and no vector.
    """
    has = F.col("v").isNotNull()
    new = deltas.where("name is not null").groupBy("id").agg(F.max(F.struct("name", has.alias("has"))).alias("_new"))
    old = base.groupBy("grp", "id").agg(F.max(has).alias("_old"))
    rows = pool.where("grp is not null").select("grp", "id", "created_at").join(old, ["grp", "id"], "left").join(new, "id", "left")
    origin = F.when(F.col("_new").isNotNull(), F.when(F.col("_new.has"), F.col("_new.name"))).when(F.col("_old"), "base")
    return rows.select("grp", "id", "created_at", origin.alias("origin"), F.col("_new").isNotNull().alias("new"))


def fetched(rows: DataFrame, base: DataFrame, deltas: DataFrame) -> DataFrame:
    """(grp, id, origin, v): the vector of each of the covered rows (grp, id, origin, new) that has one."""
    wanted = rows.where("origin is not null").select("grp", "id", "origin", "new")
    both = base.select("id", F.col("grp").alias("_grp"), F.lit(None).cast("string").alias("_name"), "v")
    both = both.unionByName(deltas.where("name is not null").select("id", F.lit(None).cast(base.schema["grp"].dataType).alias("_grp"), F.col("name").alias("_name"), "v"))
    mine = F.when(F.col("new"), F.col("origin") == F.col("_name")).otherwise(F.col("_name").isNull() & (F.col("grp") == F.col("_grp")))
    return wanted.join(both.where("v is not null"), "id").where(mine).groupBy("grp", "id", "origin").agg(F.first("v").alias("v"))


def unit_checked(rows: DataFrame) -> DataFrame:
    """(grp, id, origin, v) with vectors of length one; a vector that isn't finite and other than zero is an error, as are two lengths in one group."""
    v = F.transform("v", lambda x: x.cast("double"))
    norm = F.sqrt(dot("v", "v"))
    out = rows.withColumn("v", v).withColumn("_n", norm).withColumn("_d", F.size("v"))
    out = checked(out, ~((F.col("_n") > 0) & (F.col("_n") < float("inf"))) | F.col("_n").isNull() | F.isnan("_n"), F.concat(F.lit("vectors must be finite and nonzero: id "), F.col("id").cast("string")))
    d = out.groupBy("grp").agg(F.min("_d").alias("_low"), F.max("_d").alias("_high"))
    d = checked(d, F.col("_low") != F.col("_high"), F.format_string("group %s has vectors of %d and %d dimensions", F.col("grp").cast("string"), "_low", "_high"))
    return out.join(d.select("grp"), "grp", "left_semi").select("grp", "id", "origin", F.transform("v", lambda x: x / F.col("_n")).alias("v"))


def lateness(rows: DataFrame, pool: DataFrame, grace_hours: float, open_pool: DataFrame | None) -> DataFrame:
    """(grp, n, uncovered, late): a group's records, those without a vector, and those of them that have been there longer than the grace.

    Age counts back from the pool's newest record. With open_pool (id, created_at), only records that it knows, or that are newer
    than all of it, count as late, so that a stalled list of open ones can't hide them.
    """
    newest = pool.agg(F.max("created_at").alias("c")).first()["c"]
    old = F.col("created_at") < F.lit(newest).cast("timestamp") - F.expr(f"make_dt_interval(0, 0, 0, {grace_hours * 3600})")
    if open_pool is not None:
        horizon = open_pool.agg(F.max("created_at").alias("c")).first()["c"]
        rows = rows.join(open_pool.select("id").distinct().withColumn("_open", F.lit(True)), "id", "left")
        old = old & (F.col("_open").isNotNull() | F.coalesce(F.col("created_at") > F.lit(horizon).cast("timestamp"), F.lit(False)))
    bare = F.col("origin").isNull()
    return rows.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(bare).alias("uncovered"), F.count_if(bare & F.coalesce(old, F.lit(False))).alias("late"))


def assemble(pool: DataFrame, base: DataFrame, deltas: DataFrame, most_uncovered: float = MOST_UNCOVERED, grace_hours: float = GRACE_HOURS, open_pool: DataFrame | None = None) -> Bundle:
    """The bundle of a pool (id, grp, created_at, ...), or Refused, naming the group, if more than most_uncovered of a group's records are late.

    Repeated ids in the pool are an error. Records without a group need no vector and stay in the pool. Empty pool: an empty bundle.
    """
    twice = pool.groupBy("id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the pool holds id {twice[0]['id']} {twice[0]['count']} times")
    rows = kept(covered(pool, base, deltas))
    groups = kept(lateness(rows, pool, grace_hours, open_pool))
    worst = groups.where(F.col("late") > most_uncovered * F.col("n")).orderBy((F.col("late") / F.col("n")).desc(), "grp").first()
    if worst:
        raise Refused(f"{worst['grp']} has {worst['late']} of {worst['n']} records older than {grace_hours:g} h without a vector ({worst['late'] / worst['n']:.2%} > {most_uncovered:.2%})")
    bare = rows.where("origin is null").select("grp", "id")
    return Bundle(unit_checked(fetched(rows, base, deltas)), pool.join(bare.select("id"), "id", "left_anti").select(pool.columns), bare, groups)


def published(bundle: Bundle, folder: str) -> str:
    """Writes the bundle below a folder, and only when all of it is there the row that names it as the present one; its name."""
    spark = bundle.pool.sparkSession
    name = f"bundle-{uuid.uuid4().hex}"
    for part in BUNDLE:
        getattr(bundle, part).write.parquet(f"{folder}/{name}/{part}", compression="zstd")
    counts = [getattr(present(spark, f"{folder}/{name}"), part).count() for part in BUNDLE[:2]]
    row = spark.createDataFrame([(name, *counts)], "name string, vectors long, pool long").withColumn("at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{folder}/published")
    return name


def present(spark: SparkSession, path: str) -> Bundle:
    """What was written at a path."""
    parts = [spark.read.parquet(f"{path}/{p}") for p in BUNDLE]
    return Bundle(*parts, parts[2].groupBy("grp").agg(F.count("*").alias("uncovered")))


def current(spark: SparkSession, folder: str) -> Bundle:
    """The bundle published last; an earlier one stays readable until it is deleted."""
    last = spark.read.parquet(f"{folder}/published").orderBy(F.col("at").desc(), "name").first()
    return present(spark, f"{folder}/{last['name']}")
