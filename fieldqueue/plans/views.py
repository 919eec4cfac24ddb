"""The given tables in the roles of records, identifications and lists, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldqueue.operators import batches
from fieldqueue.plans.batching import ARM_SQL, ARMS, KEY
from fieldqueue.sources.tables import table

RANKS = ["species", "genus", "family", "order", "class", "phylum", "kingdom"]


def pool(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("grp"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderkey") % 7 != 0, F.floor("o_totalprice") / 1048576).alias("score"),
    )


POOL = "pool as (select o_orderkey id, o_custkey user_id, o_orderpriority grp, o_orderstatus status, o_orderdate created_at, case when o_orderkey % 7 <> 0 then floor(o_totalprice) / 1048576 end score from orders)"


def idents(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("id"),
        F.when(F.col("l_suppkey") % 11 != 0, F.col("l_suppkey")).alias("user_id"),
        F.col("l_shipdate").alias("created_at"),
        F.element_at(F.array(*[F.lit(r) for r in RANKS]), (F.col("l_linenumber") - 1) % 7 + 1).alias("rank"),
        F.when(F.col("l_orderkey") % 5 != 0, F.col("l_orderkey") % 100 + 1).alias("observer_id"),
        F.col("l_partkey").alias("taxon_id"),
        F.col("l_linenumber").alias("seq"),
        F.col("l_returnflag").alias("answer"),
    )


IDENTS = """idents as (select l_orderkey id, case when l_suppkey % 11 <> 0 then l_suppkey end user_id, l_shipdate created_at,
    (['species', 'genus', 'family', 'order', 'class', 'phylum', 'kingdom'])[(l_linenumber - 1) % 7 + 1] rank,
    case when l_orderkey % 5 <> 0 then l_orderkey % 100 + 1 end observer_id, l_partkey taxon_id, l_linenumber seq, l_returnflag answer from lineitem)"""


def served(spark: SparkSession, d: str) -> DataFrame:
    p = pool(spark, d).where(F.col("id") % 3 == 0)
    return batches.assign_keyed(p, ARMS, KEY).select("id", "arm", "score", (F.col("id") % 50).cast("int").alias("position"))


SERVED = f"served as (select o_orderkey id, {ARM_SQL} arm, case when o_orderkey % 7 <> 0 then floor(o_totalprice) / 1048576 end score, (o_orderkey % 50)::INT \"position\" from orders where o_orderkey % 3 = 0)"
WINDOW = ("1995-01-01", "1997-01-01")
PAIRS = f"""pairs as (select distinct user_id, id from idents where created_at >= timestamp '{WINDOW[0]}' and created_at < timestamp '{WINDOW[1]}'
    and rank in ('species', 'genus') and user_id is not null and coalesce(user_id <> observer_id, true) and id in (select id from served))"""
