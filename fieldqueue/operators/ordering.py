"""Orders of lists, places within groups, and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldqueue.sources.shared import kept


def finite(c: str) -> Column:
    """A score, null where it is NaN or infinite."""
    x = F.col(c)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)



def recency() -> list[Column]:
    return [F.col("created_at").desc_nulls_last(), F.col("id").desc()]


def by_score(c: str) -> list[Column]:
    """Best first, those without a finite score last, then newest."""
    return [finite(c).desc_nulls_last(), *recency()]


def by_surprise(columns: list[str]) -> list[Column]:
    """Surprise, then its model's score, then fewest references; keys that the pool lacks are left out."""
    keys = {"surprise": F.col("surprise").desc_nulls_last(), "surprise_model": F.col("surprise_model").desc_nulls_last(), "surprise_n": F.col("surprise_n").asc_nulls_last()}
    return [k for n, k in keys.items() if n in columns] + recency()


def place(df: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """0 for the first row of a group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def same(a: str, b: str, columns: list[str]) -> Column:
    """Equality of columns of two aliases, null being a value."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "place", size: str | None = None) -> DataFrame:
    """place() for whole groups of any size, and the group's size if a name is given.

    Rows are dealt out by ranges of group and order; each range is numbered by itself, and the rows of a group's ranges
    before it are added, so that no group is sorted in one task.
    """
    d = kept(df.repartitionByRange(*[F.col(b) for b in by], *order).withColumn("_part", F.spark_partition_id()))
    n = d.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    of = Window.partitionBy(*by)
    n = n.withColumn("_before", F.sum("_n").over(of.orderBy("_part")) - F.col("_n")).withColumn("_size", F.sum("_n").over(of))
    within = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    out = d.withColumn("_within", within).alias("d").join(n.alias("n"), same("d", "n", [*by, "_part"]))
    more = [] if size is None else [F.col("n._size").alias(size)]
    return out.select("d.*", (F.col("n._before") + F.col("_within")).alias(name), *more).drop("_part", "_within")


def summed_before(df: DataFrame, by: list[str], order: list[Column], weight: str, name: str) -> DataFrame:
    """Adds the sum of `weight` over the rows of the group before each row; whole groups of any size, by ranges as in ranked()."""
    d = kept(df.repartitionByRange(*[F.col(b) for b in by], *order).withColumn("_part", F.spark_partition_id()))
    n = d.groupBy(*by, "_part").agg(F.sum(weight).alias("_n"))
    n = n.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n"))
    upto = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = F.sum(weight).over(upto) - F.col(weight)
    out = d.withColumn("_within", within).alias("d").join(n.alias("n"), same("d", "n", [*by, "_part"]))
    return out.select("d.*", (F.col("n._before") + F.col("_within")).alias(name)).drop("_part", "_within")


def top_share(df: DataFrame, by: str, score: str, share: float) -> DataFrame:
    """Adds `picked`: place from 1 over the group's size is at most the share (ties broken by id)."""
    r = ranked(df, [by], [F.col(score).desc_nulls_last(), F.col("id").asc()], "_r", "_m")
    return r.withColumn("picked", (F.col("_r") + 1) / F.col("_m") <= share).drop("_r", "_m")


def group_quantile(df: DataFrame, by: str, score: str, q: float) -> DataFrame:
    """Adds `cut`, the group's linear quantile of a score, from the one or two rows on which it falls."""
    r = ranked(df.where(F.col(score).isNotNull()), [by], [F.col(score).asc()], "_r", "_m")
    at = F.lit(q) * (F.col("_m") - 1)
    near = r.where(F.col("_r").between(F.floor(at), F.ceil(at))).groupBy(by).agg(F.min(score).alias("_a"), F.max(score).alias("_b"), F.first(at - F.floor(at)).alias("_t"))
    return df.join(near.select(by, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t")).alias("cut")), by)


def interleaved(df: DataFrame, by: str, draw: str) -> DataFrame:
    """Round-robin: the first of every group by draw, then the second of each; groups ordered by their least draw."""
    least = df.groupBy(by).agg(F.min(draw).alias("_least"))
    return ranked(df, [by], [F.col(draw).asc(), F.col("id").asc()], "turn").join(least, by)


def sixteenths(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """Places from the last, in sixteenths of the group, and as percent from the first."""
    r, n = F.col("_r"), F.col("_m")
    out = ranked(df, [by], order, "_r", "_m")
    return out.withColumn("q16", F.floor((n - 1 - r) * 16 / n).cast("int")).withColumn("pct", F.ceil(100 * (r + 1) / n).cast("int")).drop("_r", "_m")


def first_lists(df: DataFrame, by: str, taxon: str, key: Column, per: int) -> DataFrame:
    """At most `per` rows of a taxon in each group, unless the group has one taxon only; `rest` counts those left out."""
    one = F.min(taxon).over(Window.partitionBy(by)) == F.max(taxon).over(Window.partitionBy(by))
    nth = F.row_number().over(Window.partitionBy(by, taxon).orderBy(key.desc_nulls_last(), F.col("id").desc()))
    marked = df.withColumn("_in", one | (nth <= per))
    return marked.withColumn("rest", F.count_if(~F.col("_in")).over(Window.partitionBy(by))).where("_in").drop("_in")


def seeded(seed: int, *columns: str) -> Column:
    """A draw in [0, 1) that only the seed and the columns decide."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def sample_strata(df: DataFrame, by: list[str], n: int, seed: int) -> DataFrame:
    """At most n rows of each stratum, by a seeded draw."""
    d = df.withColumn("_draw", seeded(seed, "id"))
    return place(d, by, [F.col("_draw"), F.col("id")], "_p").where(F.col("_p") < n).drop("_p", "_draw")


def share_cover(df: DataFrame, by: str, item: str, share: float, least: int) -> DataFrame:
    """Per user the commonest items that together hold the share of their rows; users of fewer rows have none."""
    n = df.groupBy(by, item).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.col("n").desc(), F.col(item).asc())
    total = F.sum("n").over(Window.partitionBy(by))
    n = n.withColumn("_total", total).withColumn("_before", F.sum("n").over(w) - F.col("n"))
    return n.where((F.col("_total") >= least) & (F.col("_before") < share * F.col("_total"))).select(by, item, "n")


def top_k_means(df: DataFrame, outcome: str, order: list[Column], ks: list[int]) -> DataFrame:
    """Mean outcome of the first k rows for each k; only the largest k rows are sorted out."""
    best = df.orderBy(*order).limit(max(ks)).withColumn("_p", F.row_number().over(Window.partitionBy().orderBy(*order)))
    return best.agg(*[F.avg(F.when(F.col("_p") <= k, F.col(outcome))).alias(f"top{k}") for k in ks])


def fused(lists: DataFrame, whole: str, k: int) -> DataFrame:
    """Ranked lists (list, id, score) as one: an id scores the least of its scores, in a list without it that list's lowest."""
    floors = lists.groupBy("list").agg(F.min("score").alias("_floor"))
    ids = lists.select("id").distinct()
    full = ids.join(F.broadcast(floors)).join(lists, ["id", "list"], "left")  # a row for each list that is fused
    best = full.groupBy("id").agg(F.min(F.coalesce("score", "_floor")).alias("fused"), F.max(F.when(F.col("list") == whole, F.col("score"))).alias("_whole"))
    return best.orderBy(F.col("fused").desc(), F.col("_whole").desc_nulls_last(), "id").limit(k).select("id", "fused")
