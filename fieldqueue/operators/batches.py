"""Assignment of records to lists, ordering, and cutting into batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldqueue.functions.hashing import keyed_bucket
from fieldqueue.operators.ordering import ranked


def assign_keyed(pool: DataFrame, arms: list[str], key: bytes) -> DataFrame:
    """Adds `arm`: a pure function of the key and the id, so that it survives any change of the pool."""
    names = F.array(*[F.lit(a) for a in arms])
    return pool.withColumn("arm", F.element_at(names, keyed_bucket(key, F.col("id").cast("string"), len(arms)) + 1))


def build_batches(assigned: DataFrame, order: list[Column], size: int, max_batches: int | None = None) -> DataFrame:
    """One row for each record that a batch holds: batch_id, arm, group, position, id.

    Each (arm, group) is ordered, cut off after max_batches and dealt out in runs of `size`.
    """
    rank = F.row_number().over(Window.partitionBy("arm", "group").orderBy(*order))
    ranked = assigned.withColumn("_place", rank)
    if max_batches is not None:
        ranked = ranked.where(F.col("_place") <= size * max_batches)
    batch = F.floor((F.col("_place") - 1) / size).cast("int")
    return ranked.select(
        F.concat_ws("-", "arm", "group", F.format_string("%03d", batch)).alias("batch_id"),
        "arm",
        "group",
        ((F.col("_place") - 1) % size).cast("int").alias("position"),
        "id",
    )


def deal_stratified(pool: DataFrame, arms: list[str], seed: int) -> DataFrame:
    """(id, arm, stratum): each stratum's ids in a seeded order, dealt to the lists in turn, from a start that moves on with each stratum.

    A list's share of a stratum is the same within one record. Strata are numbered in their order, one row each.
    """
    if not arms or len(set(arms)) != len(arms):
        raise ValueError(f"lists must be given and unique: {arms}")
    start = pool.select("stratum").distinct().withColumn("_start", F.row_number().over(Window.orderBy("stratum")) - 1)
    draw = pool.withColumn("_draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("stratum"), F.col("id").cast("string"))))
    placed = ranked(draw, ["stratum"], [F.col("_draw").asc(), F.col("id").asc()], "_at").join(start, "stratum")
    names = F.array(*[F.lit(a) for a in arms])
    return placed.select("id", F.element_at(names, ((F.col("_start") + F.col("_at")) % len(arms) + 1).cast("int")).alias("arm"), "stratum")
