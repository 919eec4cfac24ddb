"""Tests of blind reviews: Welch's t, rank correlation by sums over distinct values, and detection with its bootstrap."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldqueue.operators.ordering import summed_before

#: Steps of a continued fraction; resamples that stand in memory at once.
STEPS, AT_ONCE = 300, 200


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number, by its asymptotic series eight steps up."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    out = (z - 0.5) * F.log(z) - z + F.lit(0.9189385332046727) + series
    for i in range(8):
        out = out - F.log(x + i)
    return out


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    a, b, x = a.cast("double"), b.cast("double"), x.cast("double")

    def fraction(x: Column, a: Column, b: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("c"), (1 / (1 - (a + b) * x / (a + 1))).alias("d"), (1 / (1 - (a + b) * x / (a + 1))).alias("h"))

        def half(s: Column, k: Column) -> Column:
            d, c = 1 / (1 + k * s["d"]), 1 + k / s["c"]
            return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

        def step(s: Column, i: Column) -> Column:
            m = i.cast("double")
            first = half(s, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
            return half(first, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["h"]

    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    inside = F.when(x < (a + 1) / (a + b + 2), front * fraction(x, a, b) / a).otherwise(1 - front * fraction(1 - x, b, a) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def two_sided(t: Column, df: Column) -> Column:
    """Probability that Student's t is as far from 0."""
    return incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5))


def welch(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, difference, t, df, p) for the means of `value` in groups a and b (rows grp, value), without equal variances; p is 1 if neither varies, null with fewer than two values on a side or a difference of none."""
    of = lambda g: [f(F.when(F.col("grp") == g, F.col("value").cast("double"))).alias(f"{n}_{i}") for i in ("a" if g == a else "b",) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    s = rows.agg(*of(a), *of(b))
    va, vb = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    s = s.withColumn("difference", F.col("m_a") - F.col("m_b")).withColumn("t", F.try_divide(F.col("difference"), F.sqrt(va + vb)))
    df = F.try_divide((va + vb) * (va + vb), va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))
    p = F.when((F.col("n_a") < 2) | (F.col("n_b") < 2), None).when(va + vb == 0, 1.0).otherwise(two_sided(F.col("t"), F.col("df")))
    return s.withColumn("df", df).select((F.col("n_a") + F.col("n_b")).alias("n"), "difference", "t", "df", p.alias("p"))


def mid_ranks(counts: DataFrame, x: str) -> DataFrame:
    """(x, rank): the mean place of each distinct value among all rows, from rows (x, n); sums of ranges give what lies before."""
    c = counts.groupBy(x).agg(F.sum("n").alias("n"))
    return summed_before(c, [], [F.col(x).asc()], "n", "_before").select(x, (F.col("_before") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, rho, p): rank correlation with mid-ranks, and the probability of one as low. Rows are counted by their two values first; null or constant columns have neither."""
    c = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    r = c.join(mid_ranks(c, "x").withColumnRenamed("rank", "rx"), "x").join(mid_ranks(c, "y").withColumnRenamed("rank", "ry"), "y")
    mean = lambda v: F.sum(F.col("n") * v)
    s = r.agg(F.sum("n").alias("n"), mean(F.col("rx")).alias("sx"), mean(F.col("ry")).alias("sy"), mean(F.col("rx") * F.col("rx")).alias("xx"), mean(F.col("ry") * F.col("ry")).alias("yy"), mean(F.col("rx") * F.col("ry")).alias("xy"))
    var = lambda a, b, c: F.col(a) - F.col(b) * F.col(c) / F.col("n")
    rho = F.try_divide(var("xy", "sx", "sy"), F.sqrt(var("xx", "sx", "sx") * var("yy", "sy", "sy")))
    s = s.select(F.coalesce("n", F.lit(0)).alias("n"), F.when(rho.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))).alias("rho"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))
    half = two_sided(t, F.col("n") - 2) / 2
    p = F.when(F.col("n") < 3, None).when(F.abs("rho") >= 1, F.when(F.col("rho") < 0, 0.0).otherwise(1.0)).otherwise(F.when(t < 0, half).otherwise(1 - half))
    return s.select("n", "rho", F.when(F.col("rho").isNotNull(), p).alias("p"))


def corrected(share: np.ndarray, c: np.ndarray | float) -> np.ndarray:
    """Error share freed from a known error share of the judges, within 0 and 1."""
    return np.clip((share - c) / (1 - 2 * c), 0, 1)


def errors_of_judges(c: float, n: int, reps: int, seed: int) -> np.ndarray | float:
    """The judges' error share in each resample, from its Jeffreys posterior if it was measured on n records."""
    return np.random.default_rng([seed, 1]).beta(c * n + 0.5, (1 - c) * n + 0.5, reps) if n else c


def resampled(key: str, n: np.ndarray, values: np.ndarray, reps: int, seed: int) -> np.ndarray:
    """Means of the columns of `values` in resamples of their rows, each of which stands for n equal records: to draw records with replacement is to draw how often each row comes."""
    rng = np.random.default_rng([seed, zlib.crc32(key.encode())])
    total = int(n.sum())
    return np.concatenate([rng.multinomial(total, n / total, min(AT_ONCE, reps - i)) @ values / total for i in range(0, reps, AT_ONCE)])


def detection(scored: DataFrame, by: str, reps: int = 1000, seed: int = 0, c: float = 0.0, c_n: int = 0, nowcast: bool = False) -> DataFrame:
    """(by, source, n, error, overturned, detected, low, high) of settled records (by, source, wrong, over, complete), all together under 'all' too.

    error: share against the consensus, freed from its own error c; overturned: share that the public overturned, with nowcast
    over the sum of `complete`, the expected share of corrections that had time to come; detected: their ratio, above 1 where the public
    found more than the consensus, null without an error; low and high: its middle 95 % over resampled
    records, each with its own c if that was measured on c_n records. Equal records are counted first and
    drawn by their number, so that a group's task reads its distinct rows.
    """
    rows = scored.select(F.col(by).cast("string").alias("_by"), "source", F.col("wrong").cast("double").alias("w"), F.col("over").cast("double").alias("o"), (F.col("complete").cast("double") if nowcast else F.lit(1.0)).alias("e"))
    rows = rows.unionByName(rows.withColumn("_by", F.lit("all"))).groupBy("_by", "source", "w", "o", "e").agg(F.count("*").alias("n"))

    def tested(table: pa.Table) -> pa.Table:
        t = table.sort_by([("w", "ascending"), ("o", "ascending"), ("e", "ascending")])
        group, source = t.column("_by")[0].as_py(), t.column("source")[0].as_py()
        n, values = np.asarray(t.column("n")), np.stack([np.asarray(t.column(k)) for k in "woe"], 1)
        share = lambda m, c: np.divide(m[..., 1] / np.where(m[..., 2] > 0, m[..., 2], np.nan), e := corrected(m[..., 0], c), out=np.full(np.shape(e), np.nan), where=e > 0)
        whole = (n @ values / n.sum())[None, :]
        many = share(resampled(f"{group}|{source}", n, values, reps, seed), errors_of_judges(c, c_n, reps, seed))
        many = many[~np.isnan(many)]
        low, high = np.percentile(many, [2.5, 97.5]).tolist() if len(many) else (None, None)
        d = float(share(whole, c)[0])
        out = [group, source, int(n.sum()), float(corrected(whole[0, 0], c)), float(whole[0, 1] / whole[0, 2]) if whole[0, 2] else None, None if np.isnan(d) else d, low, high]
        kinds = [pa.string(), t.schema.field("source").type, pa.int64(), *[pa.float64()] * 5]
        return pa.Table.from_arrays([pa.array([x], k) for x, k in zip(out, kinds)], ["grp", "source", "n", "error", "overturned", "detected", "low", "high"])

    kind = scored.schema["source"].dataType.simpleString()
    found = rows.groupBy("_by", "source").applyInArrow(tested, f"grp string, source {kind}, n long, error double, overturned double, detected double, low double, high double")
    return found.withColumnRenamed("grp", by)


def scored(consensus: DataFrame, firsts: DataFrame, public: DataFrame | None, threshold: float) -> DataFrame:
    """Settled records with `wrong` (the first answer isn't the consensus) and, given public answers (record, public), `over` (it isn't theirs). Rows (record, label, posterior) and (record, first, source, ...)."""
    j = consensus.where((F.col("posterior") >= threshold) & F.col("label").isNotNull()).select("record", "label").join(firsts, "record")
    j = j.withColumn("wrong", (F.col("label") != F.col("first")).cast("int"))
    return j if public is None else j.join(public, "record").withColumn("over", (F.col("first") != F.col("public")).cast("int"))


def hypotheses(consensus: DataFrame, firsts: DataFrame, public: DataFrame, levels: DataFrame, arms: tuple[str, str], threshold: float = 0.9, reps: int = 4000, seed: int = 0, c: float = 0.0, c_n: int = 0) -> DataFrame:
    """(test, statistic, p, n): do the two arms' errors differ (Welch, two-sided); does the first arm's detection lie below the second's (one-sided share of resamples at or above it); does the settled share fall with the level (record, level) (rank correlation, one-sided).

    A test whose data lack an arm, an error on either side, or a second level has no row. Resamples share the judges' error.
    """
    spark = consensus.sparkSession
    a, b = arms
    j = scored(consensus, firsts, None, threshold)
    first = welch(j.select(F.col("source").alias("grp"), F.col("wrong").alias("value")), a, b).where("difference is not null")
    first = first.select(F.lit("error").alias("test"), F.col("difference").alias("statistic"), F.coalesce("p", F.lit(1.0)).alias("p"), "n")
    cells = scored(consensus, firsts, public, threshold).where(F.col("source").isin(a, b)).groupBy("source", "wrong", "over").agg(F.count("*").alias("n")).orderBy("source", "wrong", "over").collect()  # at most 8 rows
    own = {s: [r for r in cells if r["source"] == s] for s in arms}
    second = spark.createDataFrame([], "test string, statistic double, p double, n long")
    if all(any(r["wrong"] for r in own[s]) for s in arms):
        n, values = ({s: np.array([[*map(float, f(r))] for r in own[s]]) for s in arms} for f in (lambda r: (r["n"],), lambda r: (r["wrong"], r["over"])))
        n = {s: v[:, 0] for s, v in n.items()}
        draws = errors_of_judges(c, c_n, reps, seed)

        def ratio(m: np.ndarray, c: np.ndarray | float) -> np.ndarray:
            e = corrected(m[..., 0], c)
            return np.divide(m[..., 1], e, out=np.full(np.shape(e), np.nan), where=e > 0)

        whole = {s: ratio((n[s] @ values[s] / n[s].sum())[None, :], c)[0] for s in arms}
        many = ratio(resampled(a, n[a], values[a], reps, seed), draws) - ratio(resampled(b, n[b], values[b], reps, seed), draws)
        many = many[~np.isnan(many)]
        p = float((many >= 0).mean()) if len(many) else None
        d = float(whole[a] - whole[b])
        second = spark.createDataFrame([("detection", None if np.isnan(d) else d, p, int(sum(x.sum() for x in n.values())))], second.schema)
    settled = ((F.col("posterior") >= threshold) & F.col("label").isNotNull()).cast("int")
    third = spearman(consensus.join(levels, "record").withColumn("settled", settled), "level", "settled").where("rho is not null")
    third = third.select(F.lit("levels").alias("test"), F.col("rho").alias("statistic"), "p", "n")
    return first.unionByName(second).unionByName(third)


def level_errors(held: DataFrame) -> DataFrame:
    """(level, n, wrong): error share of held-out records (level, wrong) by level, those without a level left out."""
    return held.where("level is not null").groupBy("level").agg(F.count("*").alias("n"), F.avg("wrong").alias("wrong"))


def random_bands(rows: DataFrame, outcomes: list[str], ks: list[int], reps: int = 200, seed: int = 0) -> DataFrame:
    """(k, outcome, low, mid, high): 2.5th, 50th and 97.5th percentiles of each outcome's share among the first k rows (id, outcomes) of `reps` random orders.

    A repetition's order is that of a hash of seed, repetition and id. Only draws below a bound that leaves more than the greatest k in
    all likelihood are kept, before anything is shuffled; if one repetition has fewer for all that, the bound is doubled and the
    draws are taken again, so the first k are exact.
    """
    n = rows.count()
    k = min(max(ks), n)
    d = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("id").cast("string"))
    u = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))
    bound = (k + 8 * k**0.5 + 32) / max(n, 1)
    while bound < 1:
        fewest = d.where(u < bound).groupBy("rep").count().agg(F.min("count"), F.count("*")).first()
        if fewest[1] == reps and fewest[0] >= k:
            break
        bound *= 2
    place = F.row_number().over(Window.partitionBy("rep").orderBy("_u", "id"))
    top = d.withColumn("_u", u).where(F.col("_u") < bound).withColumn("_place", place).where(F.col("_place") <= k)
    return banded(top, outcomes, ks)


def shares(top: DataFrame, outcomes: list[str], ks: list[int], *by: str) -> DataFrame:
    """(by, k, outcome, share) among the first k rows (by, _place from 1, outcomes)."""
    rows = top.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("_place") <= F.col("k"))
    s = rows.groupBy(*by, "k").agg(*[F.avg(F.col(o).cast("double")).alias(o) for o in outcomes])
    return s.select(*by, "k", F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("share")) for o in outcomes])).alias("x")).select(*by, "k", "x.*")


def banded(top: DataFrame, outcomes: list[str], ks: list[int]) -> DataFrame:
    s = shares(top, outcomes, ks, "rep")
    return s.groupBy("k", "outcome").agg(*[F.percentile("share", F.lit(q)).alias(n) for n, q in (("low", 0.025), ("mid", 0.5), ("high", 0.975))])


def compared(rows: DataFrame, orders: dict[str, list[Column]], outcomes: list[str], ks: list[int], reps: int = 200, seed: int = 0) -> DataFrame:
    """(order, k, outcome, share, low, high): each order's shares among its first k rows beside the random band.

    Orders are sort keys; ties should end at the id. Of each only the first max(ks) rows are sorted out, by Spark's own top-k.
    Fewer rows than k: all of them.
    """
    k = max(ks)
    out = None
    for name, order in orders.items():
        place = F.row_number().over(Window.orderBy(*order))  # over max(ks) rows
        top = rows.orderBy(*order).limit(k).withColumn("_place", place).withColumn("order", F.lit(name))
        out = top if out is None else out.unionByName(top)
    band = random_bands(rows.select("id", *outcomes), outcomes, ks, reps, seed)
    return shares(out, outcomes, ks, "order").join(band, ["k", "outcome"]).select("order", "k", "outcome", "share", "low", "high")
