"""Queries of assignment and batching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldqueue.operators import batches
from fieldqueue.sources.tables import table

KEY = b"fieldqueue-demo-key"
ARMS = ["control", "novelty", "recency"]


def orders_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table as a pool of records."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("group"),
        F.col("o_orderdate").alias("created_at"),
    )


def build_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = batches.assign_keyed(orders_pool(spark, sf_dir), ARMS, KEY)
    return batches.build_batches(pool, [F.col("created_at").desc_nulls_last(), F.col("id").desc()], 50, 20)


def hmac_sql(text: str) -> str:
    block = KEY.ljust(64, b"\0")
    pad = {x: bytes(b ^ x for b in block).hex() for x in (0x36, 0x5C)}
    return f"sha256(unhex('{pad[0x5C]}') || unhex(sha256(unhex('{pad[0x36]}') || encode({text}))))"


ARM_SQL = f"""(['control', 'novelty', 'recency'])[(('0x' || substr({hmac_sql('o_orderkey::VARCHAR')}, 1, 16))::UBIGINT % 3)::INT + 1]"""

QUERIES = {"build_batches": build_batches}

ORACLE = {
    "build_batches": f"""
with pool as (select o_orderkey id, o_orderpriority grp, o_orderdate created_at, {ARM_SQL} arm from orders),
ranked as (select *, row_number() over (partition by arm, grp order by created_at desc nulls last, id desc) r from pool)
select arm || '-' || grp || '-' || printf('%03d', (r - 1) // 50) batch_id, arm, grp "group", ((r - 1) % 50)::INT "position", id
from ranked where r <= 1000""",
}
