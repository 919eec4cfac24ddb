"""Tests and intervals of experiments, by sums of equal values rather than by rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldqueue.functions.hashing import md5_heads, numbered
from fieldqueue.sources.shared import kept

#: Coins that one hash gives; differences up to which all signs are tried; repetitions of a bootstrap at most.
COINS, EXACT, BOOTSTRAPS = 60, 12, 2000
#: Hashes of a task, about, and those that stand in memory at once; numbers that a bootstrap draws at once.
HASHES, HELD, DRAWN = 1 << 25, 1 << 14, 1 << 20


def coin_sums(names: list[str], reps: int, seed: int):
    """(keys, s): what the signs of each repetition make of the sizes of a key, in one row a run of equal keys; from rows (keys, v, unit, word, k), a word of k coins of a size each."""
    blocks = [np.arange(10**i, min(10 ** (i + 1), reps + 1)) for i in range(len(str(reps))) if reps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [numbered(f"{seed}:".encode(), b) for b in blocks]
        for batch in batches:
            keys = batch.select(names)
            own = list(zip(*(c.to_pylist() for c in keys.columns)))
            v, k = batch.column("v").to_numpy(), batch.column("k").to_numpy()
            suffixes = [f":{u}:{w}".encode() for u, w in zip(batch.column("unit").to_pylist(), batch.column("word").to_pylist())]
            cut = [0, *[i for i in range(1, len(own)) if own[i] != own[i - 1]], len(own)]
            for low, high in zip(cut[:-1], cut[1:]):
                parts = []
                for numbers, size in zip(held, map(len, blocks)):
                    part, step = np.zeros(size), max(1, HELD // size)
                    for i in range(low, high, step):
                        at = slice(i, min(i + step, high))
                        mask = (np.uint64(1) << k[at].astype(np.uint64)) - np.uint64(1)
                        ones = np.bitwise_count(md5_heads(numbers, suffixes[at]) & mask[:, None])
                        part += v[at] @ (2.0 * ones - k[at, None])
                    parts.append(part)
                if high > low:
                    sums = pa.array([np.concatenate(parts)], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*keys.slice(low, 1).columns, sums], [*names, "s"])

    return run


def sign_flip(values: DataFrame, keys: list[str], reps: int, seed: int, greater: bool = False) -> DataFrame:
    """(keys, total, p): each key's sum of `d`, and the share of random signs whose sum is as far from 0 (or as high, if `greater`).

    Up to EXACT values other than 0, all signs are tried. Beyond, equal sizes are one row each: the number of them
    that come out positive is the number of ones in as many coins, so that a repetition reads distinct sizes and
    not values. COINS of a size are a word, whose coins of a repetition are bits that only the seed, the repetition, the size and
    the word decide; words are dealt out to tasks by their number. (hits + 1) / (reps + 1). A key without such values has p 1.
    """
    by = kept(values.groupBy(*keys, F.col("d").cast("double").alias("d")).agg(F.count("*").alias("m")))
    every = by.groupBy(*keys).agg(F.coalesce(F.sum(F.col("d") * F.col("m")), F.lit(0.0)).alias("total"), F.coalesce(F.sum(F.when(F.col("d") != 0, F.col("m"))), F.lit(0)).alias("_n"))
    bound = (F.col("total") if greater else F.abs("total")) - 1e-9
    some = by.where("d <> 0").join(every, keys)
    reached = (F.col("s") if greater else F.abs("s")) >= bound
    same = F.array_repeat(F.abs("d"), F.col("m").cast("int"))
    few = some.where(F.col("_n") <= EXACT).groupBy(*keys).agg(F.flatten(F.collect_list(same)).alias("v"), F.first("total").alias("total"))
    few = few.withColumn("code", F.explode(F.expr("sequence(0, shiftleft(1, size(v)) - 1)")))
    signed = F.expr("aggregate(transform(v, (x, i) -> if((shiftright(code, i) & 1) = 1, x, -x)), 0D, (a, x) -> a + x)")
    few = few.withColumn("s", signed).groupBy(*keys).agg(F.avg(reached.cast("double")).alias("p"))
    n = by.where("d <> 0").agg(F.coalesce(F.sum(F.ceil(F.col("m") / COINS)), F.lit(0))).first()[0]
    sizes = some.where(F.col("_n") > EXACT).groupBy(*keys, F.abs("d").alias("v")).agg(F.sum("m").alias("m"))
    words = sizes.withColumn("unit", F.round(F.col("v") * 1e9).cast("long")).withColumn("word", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / COINS).cast("int"))))
    words = words.select(*keys, "v", "unit", "word", F.least(F.lit(COINS), F.col("m") - COINS * F.col("word")).alias("k"))
    words = words.repartitionByRange(max(1, -(-int(n) * reps // HASHES)), *keys, "unit", "word").sortWithinPartitions(*keys)
    schema = ", ".join(f"`{name}` {kind}" for name, kind in words.select(*keys).dtypes) + ", s array<double>"
    sums = words.mapInArrow(coin_sums(keys, reps, seed), schema).select(*keys, F.posexplode("s").alias("rep", "s")).groupBy(*keys, "rep").agg(F.sum("s").alias("s"))
    many = sums.join(every, keys).groupBy(*keys).agg(((F.count_if(reached) + 1) / F.lit(float(reps + 1))).alias("p"))
    return every.join(few.unionByName(many), keys, "left").select(*keys, "total", F.coalesce("p", F.lit(1.0)).alias("p"))


def sign_test(positive: Column, negative: Column) -> Column:
    """Two-sided exact binomial p of the signs; 1 without any."""
    n, m = positive + negative, F.least(positive, negative)
    # the tail's largest term by its logarithm; the others by their ratios to it
    top = F.aggregate(F.when(m > 0, F.sequence(F.lit(1).cast("long"), m)).otherwise(F.array().cast("array<bigint>")), -n * F.log(F.lit(2.0)), lambda a, j: a + F.log((n - m + j) / j))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def less(a: Column, j: Column) -> Column:
        term = a["term"] * (m - j) / (n - m + j + 1)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    tail = F.aggregate(F.when(m > 0, F.sequence(F.lit(0).cast("long"), m - 1)).otherwise(F.array().cast("array<bigint>")), start, less)["sum"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(top) * tail))


def differences(counts: DataFrame, arms: list[str], control: str) -> DataFrame:
    """A row for each identifier and list other than the control: x, c, and d, their difference."""
    one = [F.struct(F.lit(a).alias("arm"), F.col(a).cast("double").alias("x"), F.col(control).cast("double").alias("c")) for a in arms if a != control]
    return counts.select(F.explode(F.array(*one)).alias("r")).select("r.*", (F.col("r.x") - F.col("r.c")).alias("d"))


def adjusted(rows: DataFrame, p: str, name: str, family: Column | None = None) -> DataFrame:
    """Adds the step-down adjusted p of the rows in the family (null for others); rows are the few lists of a design."""
    inside = F.lit(True) if family is None else family
    of = Window.partitionBy(inside)
    order = of.orderBy(p, "arm")
    step = (F.count("*").over(of) - F.row_number().over(order) + 1) * F.col(p)
    rows = rows.withColumn("_step", step)
    return rows.withColumn(name, F.when(inside, F.least(F.lit(1.0), F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))))).drop("_step")


def analyse(counts: DataFrame, arms: list[str], control: str, reps: int = 10_000, seed: int = 0) -> DataFrame:
    """One row for each list beside the control: identifiers, totals, mean difference, p by sign flips and by signs, adjusted p.

    counts has a row an identifier and a column a list.
    """
    if control not in arms:
        raise ValueError(f"the control {control} is none of the lists {arms}")
    d = differences(counts, arms, control)
    sums = d.groupBy("arm").agg(F.count("*").alias("n_identifiers"), F.sum("x").alias("total"), F.sum("c").alias("total_control"), F.avg("d").alias("mean_diff"), F.count_if(F.col("d") > 0).alias("_up"), F.count_if(F.col("d") < 0).alias("_down"))
    p = sign_flip(d, ["arm"], reps, seed).select("arm", "p")
    out = sums.join(p, "arm").withColumn("p_sign", sign_test(F.col("_up"), F.col("_down"))).withColumn("control", F.lit(control))
    return adjusted(out, "p", "p_holm").select("arm", "control", "n_identifiers", "total", "total_control", "mean_diff", "p", "p_sign", "p_holm")


def ratio_interval(counts: DataFrame, arms: list[str], control: str, reps: int = 10_000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(arm, ratio, ratio_lo, ratio_hi): each list's total over the control's, and a percentile bootstrap over identifiers.

    Identifiers of equal counts are one row, and a bootstrap draws how often each such row occurs; the rows of a list,
    one a distinct pair of counts, meet in one task. Null where there are fewer than two identifiers or the control has nothing.
    """
    names = "arm string, ratio double, ratio_lo double, ratio_hi double"

    def one(arm: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, c, m = (rows[k].to_numpy(float) for k in ("x", "c", "m"))
        n, none = int(m.sum()), (float("nan"),) * 3
        if n < 2 or not (c * m).sum():
            return pd.DataFrame([(arm[0], *none)], columns=["arm", "ratio", "ratio_lo", "ratio_hi"])
        order = np.lexsort((c, x))
        x, c, m = x[order], c[order], m[order]
        rng, left, sums = np.random.default_rng(seed), min(reps, BOOTSTRAPS), []
        while left:  # what is drawn in turns is what would be drawn at once
            some = min(left, max(1, DRAWN // len(m)))
            drawn = rng.multinomial(n, m / n, size=some)
            sums.append(np.stack((drawn @ x, drawn @ c)))
            left -= some
        above, below = np.concatenate(sums or [np.zeros((2, 0))], 1)
        ratios = above[below > 0] / below[below > 0]
        ends = np.percentile(ratios, [50 * (1 - level), 100 - 50 * (1 - level)]) if len(ratios) else none[:2]
        return pd.DataFrame([(arm[0], (x * m).sum() / (c * m).sum(), *map(float, ends))], columns=["arm", "ratio", "ratio_lo", "ratio_hi"])

    pairs = differences(counts, arms, control).groupBy("arm", "x", "c").agg(F.count("*").alias("m"))
    out = pairs.groupBy("arm").applyInPandas(one, names)
    return out.select("arm", *[F.nanvl(F.col(k), F.lit(None)).alias(k) for k in ("ratio", "ratio_lo", "ratio_hi")])


def record_shuffle(totals: DataFrame, arm: str, control: str, reps: int = 10_000, seed: int = 0, greater: bool = False, strata: str | None = None) -> DataFrame:
    """One row (total, p): the sum of records' totals (id, arm, n) on a list less that on the control, and the share of re-randomisations as far from 0, or as high.

    Without strata each record of the two goes to either with an even chance, and others stay. With strata the labels
    of the two are permuted within each stratum: how many records of each total a list gets is drawn for a
    repetition at once, in a task a stratum that reads its distinct totals.
    """
    t = totals.where(F.col("arm").isin(arm, control))
    d = F.when(F.col("arm") == arm, F.col("n")).otherwise(-F.col("n")).cast("double")
    if strata is None:
        return sign_flip(t.select(F.lit(1).alias("_k"), d.alias("d")), ["_k"], reps, seed, greater).select("total", "p")
    seen = t.agg(F.coalesce(F.sum(d), F.lit(0.0)).alias("total"))
    groups = t.groupBy(F.col(strata).alias("stratum"), F.col("n").cast("double").alias("v")).agg(F.count("*").alias("m"), F.count_if(F.col("arm") == arm).alias("mine"))

    def permuted(stratum: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("v")
        own = np.frombuffer(str(stratum[0]).encode(), np.uint8).tolist()
        drawn = np.random.default_rng([seed, *own]).multivariate_hypergeometric(rows.m.to_numpy(), int(rows.mine.sum()), size=reps)
        v = rows.v.to_numpy()
        return pd.DataFrame({"rep": np.arange(reps), "s": 2 * (drawn @ v) - (rows.m.to_numpy() * v).sum()})

    sums = groups.groupBy("stratum").applyInPandas(permuted, "rep long, s double").groupBy("rep").agg(F.sum("s").alias("s"))
    reached = (F.col("s") >= F.col("total") - 1e-9) if greater else (F.abs("s") >= F.abs("total") - 1e-9)
    hits = sums.join(F.broadcast(seen)).agg(F.count_if(reached).alias("hits"))  # one row on the right
    return seen.join(F.broadcast(hits)).select("total", ((F.col("hits") + 1) / F.lit(float(reps + 1))).alias("p"))


def confirmatory(outcomes: dict[str, tuple[DataFrame, DataFrame]], arms: list[str], control: str, primary: dict[str, str], family: list[str], reps: int = 10_000, seed: int = 0) -> DataFrame:
    """Each list against the control on each outcome: analyse(), ratio_interval() and record_shuffle(), the last as p.

    outcomes: by name the counts by identifier and list, and the totals by record (id, arm, n). A list's outcome in
    `primary` is primary if the list is in the family, else exploratory, and its other outcomes are secondary. Primary
    rows are tested one-sided and adjusted among themselves; others have no adjusted p.
    """
    if missing := [a for a in arms if a != control and a not in primary]:
        raise ValueError(f"lists without a primary outcome: {missing}")
    out = None
    for outcome, (counts, totals) in outcomes.items():
        counts, totals = kept(counts), kept(totals)  # each is read by several tests
        role = lambda a, o=outcome: "secondary" if primary[a] != o else "primary" if a in family else "exploratory"
        rows = analyse(counts, arms, control, reps, seed).drop("p_holm").withColumnRenamed("p", "p_signflip").join(ratio_interval(counts, arms, control, reps, seed), "arm")
        tests = None
        for a in arms:
            if a != control:
                one = record_shuffle(totals, a, control, reps, seed, role(a) == "primary").select(F.lit(a).alias("arm"), F.lit(outcome).alias("outcome"), F.lit(role(a)).alias("role"), "p")
                tests = one if tests is None else tests.unionByName(one)
        rows = rows.join(tests, "arm")
        out = rows if out is None else out.unionByName(rows)
    return adjusted(out, "p", "p_holm", F.col("role") == "primary")
