"""Counting what participants did with the records they were served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldqueue.operators.ordering import summed_before


def one_arm(served: DataFrame) -> DataFrame:
    """id -> arm, an error where an id has more than one, and its first score that isn't null, by position."""
    first = F.min_by("score", F.when(F.col("score").isNotNull(), F.struct("position", "arm")))
    out = served.groupBy("id").agg(F.min("arm").alias("arm"), F.count_distinct("arm").alias("arms"), first.alias("score"))
    clash = F.raise_error(F.concat(F.lit("served in more than one arm: "), F.col("id").cast("string")))
    return out.select("id", F.when(F.col("arms") > 1, clash.cast("string")).otherwise(F.col("arm")).alias("arm"), "score")


def counted_pairs(idents: DataFrame, served: DataFrame, start: Column, cutoff: Column, ranks: list[str], users: DataFrame | None = None) -> DataFrame:
    """Distinct (user_id, id) of identifications that count.

    In the half-open window, at one of the ranks, by a known user other than the record's observer, on a served
    record, and by one of `users` if given.
    """
    kept = idents.where((F.col("created_at") >= start) & (F.col("created_at") < cutoff) & F.col("rank").isin(ranks) & F.col("user_id").isNotNull())
    kept = kept.where(F.coalesce(F.col("user_id") != F.col("observer_id"), F.lit(True)))
    if users is not None:
        kept = kept.join(users.select("user_id"), "user_id", "left_semi")
    return kept.join(served.select("id"), "id", "left_semi").select("user_id", "id").distinct()


def by_arm(pairs: DataFrame, arm_of: DataFrame, arms: list[str], weight: str | None = None) -> DataFrame:
    """One row a user, one column an arm, whether or not anyone worked in it: pairs, or the sum of their weights."""
    value = F.sum(F.coalesce(F.col(weight), F.lit(0.0))) if weight else F.count(F.lit(1))
    return pairs.join(arm_of, "id").groupBy("user_id").pivot("arm", arms).agg(value).fillna(0)


def record_totals(pairs: DataFrame, arm_of: DataFrame) -> DataFrame:
    """Distinct users of every served record, 0 for those nobody touched."""
    n = pairs.groupBy("id").agg(F.count("*").alias("n"))
    return arm_of.join(n, "id", "left").select("id", "arm", F.coalesce("n", F.lit(0)).alias("n"))


def exposure_summary(expo: DataFrame, arms: list[str]) -> DataFrame:
    """Per arm: users with anything, sum, and share of all."""
    long = expo.select(F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("n")) for a in arms])).alias("x")).select("x.*")
    out = long.groupBy("arm").agg(F.count_if(F.col("n") > 0).alias("users"), F.sum("n").alias("total"))
    return out.withColumn("share", F.try_divide(F.col("total"), F.sum("total").over(Window.partitionBy())))


def outsiders(idents: DataFrame, served: DataFrame, users: DataFrame, start: Column, cutoff: Column) -> DataFrame:
    """Per arm: served records, and those that somebody outside the experiment reached before any participant."""
    inside = users.select("user_id", F.lit(True).alias("_in"))
    touched = idents.where((F.col("created_at") >= start) & (F.col("created_at") < cutoff) & F.col("user_id").isNotNull()).join(inside, "user_id", "left")
    first = touched.groupBy("id").agg(F.min(F.when(F.col("_in"), F.col("created_at"))).alias("part"), F.min(F.when(F.col("_in").isNull(), F.col("created_at"))).alias("out"))
    lost = F.col("out").isNotNull() & (F.col("part").isNull() | (F.col("out") < F.col("part")))
    return served.join(first, "id", "left").groupBy("arm").agg(F.count("*").alias("n"), F.count_if(lost).alias("lost"))


def outcomes(joined: DataFrame) -> DataFrame:
    """Per arm: records, shares by state, and score of those done."""
    done = F.col("status") == "F"
    return joined.groupBy("arm").agg(
        F.count("*").alias("n"),
        F.avg(F.coalesce(done, F.lit(False)).cast("double")).alias("share_done"),
        F.avg((F.coalesce("n_idents", F.lit(0)) >= 2).cast("double")).alias("share_two"),
        F.avg((F.coalesce("n_idents", F.lit(0)) <= 1).cast("double")).alias("share_one"),
        F.sum(F.when(done, F.coalesce("score", F.lit(0.0))).otherwise(0.0)).alias("score_done"),
    )


def overturn_table(scored: DataFrame, by: str) -> DataFrame:
    """by, source: records, those tested and overturned, and the rate, null where none was tested."""
    tested, over = F.count_if("tested"), F.count_if(F.col("tested") & F.col("overturned"))
    return scored.groupBy(by, "source").agg(F.count("*").alias("n"), tested.alias("tested"), over.alias("overturned"), F.try_divide(over, tested).alias("rate"))


def mantel_haenszel(scored: DataFrame, stratum: str) -> DataFrame:
    """Risk ratio of source b over source a, pooled over strata that have both; null without a denominator."""
    n = lambda s: F.count_if((F.col("source") == s) & F.col("tested"))
    over = lambda s: F.count_if((F.col("source") == s) & F.col("tested") & F.col("overturned"))
    s = scored.groupBy(stratum).agg(n("a").alias("na"), n("b").alias("nb"), over("a").alias("oa"), over("b").alias("ob")).where("na > 0 and nb > 0")
    total = F.col("na") + F.col("nb")
    return s.agg(F.count("*").alias("strata"), F.try_divide(F.sum(F.col("ob") * F.col("na") / total), F.sum(F.col("oa") * F.col("nb") / total)).alias("ratio"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Score interval of a share; null without trials."""
    p, zz = F.try_divide(k, n), z * z
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(zz), 4 * n * n))
    mid, size = p + F.try_divide(F.lit(zz), 2 * n), 1 + F.try_divide(F.lit(zz), n)
    return F.greatest(F.lit(0.0), (mid - half) / size), F.least(F.lit(1.0), (mid + half) / size)


def corrected_share(wrong: Column, c: Column) -> Column:
    """Error share freed from a known error share c of the judges, within 0 and 1."""
    return F.least(F.greatest(F.try_divide(wrong - c, 1 - 2 * c), F.lit(0.0)), F.lit(1.0))


def holm(tests: DataFrame) -> DataFrame:
    """Step-down adjusted p values of a family of tests (name, p); a family is a few rows."""
    order = Window.partitionBy().orderBy("p", "name")
    steps = tests.withColumn("_s", (F.count("*").over(Window.partitionBy()) - F.row_number().over(order) + 1) * F.col("p"))
    return steps.select("name", "p", F.least(F.lit(1.0), F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("adjusted"))


def rank_auc(rows: DataFrame) -> DataFrame:
    """Probability that a row of y = 1 has the higher score, ties a half, from counts by score, of which ranges are summed before those after them."""
    by = rows.where("score is not null").groupBy("score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    below = summed_before(by, [], [F.col("score").asc()], "neg", "_below")
    return below.select("pos", "neg", (F.col("pos") * (F.col("_below") + F.col("neg") / 2)).alias("w")).agg(F.try_divide(F.sum("w"), F.sum("pos") * F.sum("neg")).alias("auc"), F.sum("pos").alias("positives"))
