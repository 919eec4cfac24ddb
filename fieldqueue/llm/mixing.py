"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldqueue.llm.shared import kept

WORD = r"[^\x20\x09-\x0D]+"
#: A document's random number has so many bits. Its place in the ranking, between 0 and 1, is cut into BUCKETS, and the bucket that matters into as many again.
BITS, BUCKETS = 52, 4096
#: Sources whose rows are broadcast at most; more are joined.
SOURCES = 1 << 16


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, doc_id: Column) -> Column:
    """Number in (0, 1) that only the seed and the id decide, so that reruns and lost tasks draw the same."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(2**BITS))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds `target` to one row a source (source, source_size).

    Sources in code point order, null last, weigh `weights` in turn and share out `share` times all sizes.
    No target exceeds `most` times its source's size: in the order of limit by weight, a source is at its
    limit if what remains for it and those after it would give it more.
    The windows without a key read one row a source, never documents.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    whole = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = sizes.withColumn("_w", weight)
    t = t.withColumn("_ratio", F.lit(most) * F.col("source_size") / F.col("_w"))
    t = t.withColumn("_used", F.coalesce(F.sum("source_size").over(before), F.lit(0))).withColumn("_gone", F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    t = t.withColumn("_level", (F.lit(share) * F.sum("source_size").over(every) - F.lit(most) * F.col("_used")) / (F.sum("_w").over(every) - F.col("_gone")))
    t = t.withColumn("_free", F.col("_ratio") > F.col("_level"))
    # the first source that is not at its limit sets the level for all after it
    t = t.withColumn("_level", F.min(F.when(F.col("_free"), F.struct("_ratio", F.col("source").isNull(), "source", "_level"))).over(every)["_level"])
    return t.select("source", "source_size", F.when(F.col("_free"), F.col("_w") * F.col("_level")).otherwise(F.lit(most) * F.col("source_size")).alias("target"))


def inclusion(sizes: DataFrame) -> DataFrame:
    """How each source (rows source, size, n, _rest: so many documents of so many words; the words to draw) draws: _source, _limit, _rate, _left.

    A document of at most _limit words is drawn with the probability _rate times its words, a longer one for
    certain; _left words are due from the former. Longer and longer documents would exceed 1: the limit is the
    greatest size that doesn't once all longer ones are certain. Windows read one row a source and size.
    """
    of = Window.partitionBy("source")
    longer = of.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    upto = of.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    c = sizes.where((F.col("size") > 0) & (F.col("_rest") > 0))
    c = c.withColumn("_left", F.col("_rest") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(longer), F.lit(0)))
    c = c.withColumn("_rate", F.col("_left") / F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")).over(upto))
    best = c.where(F.col("_rate") * F.col("size") < 1).groupBy("source").agg(F.max(F.struct("size", "_rate", "_left")).alias("m"))
    return best.select(F.col("source").alias("_source"), F.col("m.size").alias("_limit"), F.col("m._rate").alias("_rate"), F.col("m._left").alias("_left"))


def edge(rows: DataFrame, bucket: Column, start: Column) -> DataFrame:
    """The bucket of each source (rows source, size, _left) in which the words, `start` at first, reach what is due, and the words before it: _source, _edge, _before."""
    hist = rows.groupBy("source", bucket.alias("_b")).agg(F.sum("size").alias("_words"), F.first("_left").alias("_left"), F.first(start).alias("_start"))
    upto = F.col("_start") + F.sum("_words").over(Window.partitionBy("source").orderBy("_b"))
    hist = hist.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_words") < F.col("_left")))
    return hist.groupBy("source").agg(F.min(F.struct("_b", (F.col("_upto") - F.col("_words")).alias("w"))).alias("m")).select(F.col("source").alias("_source"), F.col("m._b").alias("_edge"), F.col("m.w").alias("_before"))


def pareto_mix(docs: DataFrame, seed: int = 8, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Copies of each document that the mix takes: doc_id, size, source, source_size, target, inclusion, copies (long), taken, _text_key.

    A source's target over its size is the copies that each of its words is due. The whole part is allocated
    to every document. The words that remain are drawn: a document's inclusion probability is in proportion to
    its words, and those for which it would reach 1 get their copy for certain. The others rank by the
    odds of their random number over the odds of inclusion, and the ranking is taken up to the words that remain
    (Pareto order sampling whose fixed size is counted in words). At the end one document a source, the one
    whose size is nearest to what still differs, is exchanged if that brings the source nearer to its target.

    The ranking is not sorted as a whole: sums by bucket of the ratio find the bucket where the words due
    are reached, sums within it a bucket of that one, and only the last one's documents (one in BUCKETS ** 2 of a
    source) are sorted. Nothing but sums, a row a source and size, and the sources' rows meets in one task.

    Null texts, empty texts: size 0, whole copies as any other. Null sources are a source. Null ids draw as
    the text 'null'. Rows of one id share their random number and rank by size and text; rows equal in all are
    interchangeable. Empty table: no rows. Other columns are ignored.
    """
    base = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("_text_key"))
    base = kept(base.withColumn("_u", uniform(seed, F.col("doc_id"))))
    sizes = kept(base.groupBy("source", "size").agg(F.count("*").alias("n")))
    plan = targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("_whole", F.floor(due).cast("long"))
    plan = kept(plan.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")).withColumnRenamed("source", "_source"))
    # tables of one row a source, for joins that a hot source would skew
    small = F.broadcast if plan.count() <= SOURCES else lambda t: t
    on = lambda a: a["source"].eqNullSafe(F.col("_source"))
    with_ = lambda a, b: a.join(small(b), on(a), "left").drop("_source")
    draws = kept(inclusion(with_(sizes, plan.select("_source", "_rest"))))
    rows = with_(with_(base, plan), draws)
    certain = (F.col("_rest") > 0) & (F.col("size") > 0) & (F.col("_limit").isNull() | (F.col("size") > F.col("_limit")))
    rows = rows.withColumn("inclusion", F.when(certain, 1.0).when((F.col("_rest") > 0) & (F.col("size") > 0), F.col("_rate") * F.col("size")).otherwise(0.0))
    ratio = F.col("_u") / (1 - F.col("_u")) / (F.col("inclusion") / (1 - F.col("inclusion")))
    drawn = (F.col("inclusion") > 0) & (F.col("inclusion") < 1)
    rows = rows.withColumn("_ratio", F.when(drawn, ratio)).withColumn("_fine", F.floor(F.col("_ratio") / (1 + F.col("_ratio")) * BUCKETS * BUCKETS).cast("long"))
    coarse = F.floor(F.col("_fine") / BUCKETS)
    ranked = rows.where(drawn).select("source", "size", "_left", "_fine")
    first = kept(edge(ranked, coarse, F.lit(0)))
    inner = with_(ranked, first).where(coarse == F.col("_edge"))
    last = kept(edge(inner, F.col("_fine"), F.col("_before")))
    rows = with_(rows, last)
    here = F.coalesce(F.col("_fine") == F.col("_edge"), F.lit(False))
    upto = Window.partitionBy("source").orderBy("_ratio", "doc_id", "size", "_text_key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum("size").over(upto), F.lit(0))
    inside = rows.where(here).withColumn("_extra", (before + F.col("size") - F.col("_left") <= F.col("_left") - before).cast("long"))
    outside = rows.where(~here).withColumn("_extra", F.when(F.col("inclusion") >= 1, 1).otherwise(F.coalesce((F.col("_fine") < F.col("_edge")).cast("long"), F.lit(0))).cast("long"))
    found = kept(outside.unionByName(inside).drop("_u", "_ratio", "_fine", "_edge", "_before"))
    # the exchange that closes what still differs
    gap = found.groupBy("source").agg((F.sum(F.col("size") * F.col("_extra")) - F.first("_rest")).alias("_over")).withColumnRenamed("source", "_source")
    near = with_(found, gap).where(drawn & (((F.col("_over") > 0) & (F.col("_extra") == 1)) | ((F.col("_over") < 0) & (F.col("_extra") == 0))))
    miss = F.abs(F.abs(F.col("_over")) - F.col("size"))
    near = near.where(miss < F.abs(F.col("_over"))).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "doc_id", "size", "_text_key")).alias("_swap")).withColumnRenamed("source", "_source")
    out = with_(found, near)
    swap = F.coalesce(F.struct("doc_id", "size", "_text_key").eqNullSafe(F.struct("_swap.doc_id", "_swap.size", "_swap._text_key")) & F.col("_swap").isNotNull(), F.lit(False))
    extra = F.when(swap, 1 - F.col("_extra")).otherwise(F.col("_extra"))
    return out.withColumn("copies", F.col("_whole") + extra).select("doc_id", "size", "source", "source_size", "target", "inclusion", "copies", (F.col("copies") * F.col("size")).alias("taken"), "_text_key")


def op8_pareto_mix(docs: DataFrame) -> DataFrame:
    """The contract's columns of pareto_mix()."""
    return pareto_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT size, md5(coalesce(text, '')) k,
        (('0x' || substr(md5('8:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE u from documents),
s as (select source, sum(size)::BIGINT source_size from d group by 1),
w as (select *, ([5.0, 2.0, 1.0])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::INT]::DOUBLE wt from s),
r as (select *, 2.0::DOUBLE * source_size / wt ratio from w),
l as (select *, coalesce(sum(source_size) over b, 0) used, coalesce(sum(wt) over b, 0) gone from r
      window b as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
v as (select *, (1.5::DOUBLE * sum(source_size) over () - 2.0::DOUBLE * used) / (sum(wt) over () - gone) lev from l),
f as (select *, ratio > lev free from v),
g as (select *, (select arg_min(lev, (ratio, source is null, source)) from f where free) one from f),
t as (select source, source_size, case when free then wt * one else 2.0::DOUBLE * source_size end target from g),
p as (select *, case when source_size > 0 then target / source_size else 0 end due from t),
q as (select *, floor(due)::BIGINT whole, target - floor(due)::BIGINT * source_size rest from p),
z as (select source, size, count(*) n from d where size > 0 group by 1, 2),
c as (select z.*, q.rest - coalesce(sum(size * n) over (partition by z.source order by size desc rows between unbounded preceding and 1 preceding), 0)::BIGINT due,
             sum(size::DOUBLE * size * n) over (partition by z.source order by size rows between unbounded preceding and current row) square
      from z join q on z.source is not distinct from q.source where rest > 0),
m as (select source, arg_max(size, size) lim, arg_max(due / square, size) rate, arg_max(due, size) due from c where due / square * size < 1 group by 1),
i as (select d.*, source_size, target, whole, rest, m.due, case when rest > 0 and size > 0 and (lim is null or size > lim) then 1 when rest > 0 and size > 0 then rate * size else 0 end::DOUBLE pi
      from d join q on d.source is not distinct from q.source left join m on d.source is not distinct from m.source),
j as (select *, case when pi > 0 and pi < 1 then u / (1 - u) / (pi / (1 - pi)) end ratio from i),
o as (select *, coalesce(sum(size) over (partition by source, ratio is null order by ratio, doc_id, size, k rows between unbounded preceding and 1 preceding), 0) before from j),
e as (select *, (pi >= 1 or (ratio is not null and before + size - due <= due - before))::BIGINT extra from o),
a as (select source, sum(size * extra) - first(rest) over_ from e group by 1),
n as (select e.source, arg_min((doc_id, size, k), (abs(abs(over_) - size), doc_id, size, k)) swap from e join a on e.source is not distinct from a.source
      where ratio is not null and ((over_ > 0 and extra = 1) or (over_ < 0 and extra = 0)) and abs(abs(over_) - size) < abs(over_) group by 1)
select doc_id, size, source_size, target,
       ((whole + case when swap is not null and (doc_id, size, k) = swap then 1 - extra else extra end) * size)::BIGINT taken
from e left join n on e.source is not distinct from n.source"""
