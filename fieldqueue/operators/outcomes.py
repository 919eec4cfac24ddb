"""Outcomes of levelled records: tables by level, cohorts, quantiles, totals, evidence counts, novelty against references and separability."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldqueue.operators.ordering import ranked
from fieldqueue.operators.vectors import STRIP, exact_neighbours, unit_rows


def level_table(consensus: DataFrame, counts: DataFrame, levels: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(level, n, settled, posterior, abstain): records of each level, the share settled, the mean posterior, the mean share of abstentions.

    Rows (record, label, posterior), (record, n_answers, n_abstain) and (record, level). A label of null is never settled.
    """
    j = consensus.join(counts, "record").join(levels, "record")
    settled = F.coalesce((F.col("posterior") >= threshold) & F.col("label").isNotNull(), F.lit(False))
    abstain = F.try_divide("n_abstain", F.col("n_answers") + F.col("n_abstain"))
    return j.groupBy("level").agg(F.count("*").alias("n"), F.avg(settled.cast("double")).alias("settled"), F.avg("posterior").alias("posterior"), F.avg(abstain).alias("abstain"))


def genus(name: Column) -> Column:
    return F.split_part(name, F.lit(" "), F.lit(1))


def cohort(leveled: DataFrame, after: DataFrame, exclude: DataFrame | None = None, leavers: DataFrame | None = None) -> DataFrame:
    """leveled (id, level, taxon_id, other_name) with left, corrected, to_suggested, to_suggested_genus and, given leavers, changed_any.

    after: rows (id, taxon_id, name) of those still there. A record is corrected if its taxon changed and the old one is still some record's, so that a
    taxon that was renamed as a whole doesn't count; to_suggested if it went to the suggested species, or to its genus. leavers: rows (id, taxon_id) of today's taxa, by
    which a record that left may have changed too. Records in `exclude` (id) are left out. Of repeated ids one row counts.
    """
    now = after.groupBy("id").agg(F.min(F.struct("taxon_id", "name")).alias("a")).select("id", F.col("a.taxon_id").alias("_now"), F.col("a.name").alias("_name"))
    used = after.select(F.col("taxon_id").alias("_used")).where("_used is not null").distinct().withColumn("_in", F.lit(True))
    d = leveled if exclude is None else leveled.join(exclude.select("id").distinct(), "id", "left_anti")
    d = d.join(now, "id", "left").join(used, F.col("taxon_id") == F.col("_used"), "left")
    held = F.coalesce("_in", F.lit(False))
    left = F.col("_now").isNull()
    changed = ~left & F.coalesce(F.col("_now") != F.col("taxon_id"), F.lit(False))
    d = d.withColumns({"left": left, "corrected": changed & held, "_changed": changed})
    out = ["left", "corrected"]
    if leavers is not None:
        gone = leavers.where("taxon_id is not null").groupBy("id").agg(F.min("taxon_id").alias("_gone"))
        d = d.join(gone, "id", "left")
        d = d.withColumn("changed_any", (F.col("_changed") | (F.col("left") & F.coalesce(F.col("_gone") != F.col("taxon_id"), F.lit(False)))) & held)
        out.append("changed_any")
    same = F.coalesce(F.col("_name") == F.col("other_name"), F.lit(False))
    kin = F.coalesce(genus(F.col("_name")) == genus(F.col("other_name")), F.lit(False))
    d = d.withColumns({"to_suggested": F.col("corrected") & same, "to_suggested_genus": F.col("corrected") & kin})
    return d.select(*leveled.columns, *out, "to_suggested", "to_suggested_genus")


def quantiles(rows: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """(by, q, value): linear quantiles of a column within groups of any size, from the one or two rows on which each falls."""
    r = ranked(rows.where(F.col(value).isNotNull()).select(*by, value), by, [F.col(value).asc()], "_r", "_m")
    at = F.col("q") * (F.col("_m") - 1)
    near = r.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).where(F.col("_r").between(F.floor(at), F.ceil(at)))
    g = near.groupBy(*by, "q").agg(F.min(value).alias("_a"), F.max(value).alias("_b"), F.first(at - F.floor(at)).alias("_t"))
    return g.select(*by, "q", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t")).alias("value"))


def described(scores: DataFrame, levels: DataFrame, qs: list[float], weird: float = 0.02, close: float = 0.75) -> DataFrame:
    """(what, grp, level, q, value): quantiles of margin, own and top over all scored rows, their cuts by group (top at `weird`, margin of those behind at 1 - `close`), and rows by group and level.

    Rows (id, grp, own, other, margin) and (id, grp, level); a null group is the empty one.
    """
    s = scores.where("margin is not null and other is not null").withColumns({"top": F.greatest("own", "other"), "grp": F.coalesce("grp", F.lit(""))})
    none = lambda kind: F.lit(None).cast(kind)
    long = s.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("x")) for c in ("margin", "own", "top")])).alias("e")).select("e.*")
    whole = quantiles(long, ["what"], "x", qs).select("what", none("string").alias("grp"), none("string").alias("level"), "q", "value")
    cuts = [(s, "top", weird, "weird cut"), (s.where("margin < 0"), "margin", 1 - close, "close cut")]
    for rows, c, q, what in cuts:
        g = quantiles(rows, ["grp"], c, [q])
        whole = whole.unionByName(g.select(F.lit(what).alias("what"), "grp", none("string").alias("level"), "q", "value"))
    n = levels.groupBy(F.coalesce("grp", F.lit("")).alias("grp"), "level").agg(F.count("*").cast("double").alias("value"))
    return whole.unionByName(n.select(F.lit("rows").alias("what"), "grp", "level", none("double").alias("q"), "value"))


def over_totals(records: DataFrame, totals: DataFrame, floor: str) -> DataFrame:
    """(kind, grp, month, n, total): group-months that hold more records than the source's totals, from rows (grp, observed_on, created_at) and (kind: obs or up, grp, month, total).

    Days before `floor` count as that day, a null group as Unknown; records without the date and months without a total are left out.
    """
    kinds = F.explode(F.array(F.struct(F.lit("obs").alias("kind"), F.col("observed_on").cast("date").alias("day")), F.struct(F.lit("up").alias("kind"), F.col("created_at").cast("date").alias("day"))))
    d = records.select(F.coalesce("grp", F.lit("Unknown")).alias("grp"), kinds.alias("k")).select("grp", "k.*").where("day is not null")
    month = F.trunc(F.greatest("day", F.lit(floor).cast("date")), "MM")
    n = d.groupBy("kind", "grp", month.alias("month")).agg(F.count("*").alias("n"))
    return n.join(totals, ["kind", "grp", "month"]).where(F.col("n") > F.col("total")).select("kind", "grp", "month", "n", "total")


def evidence_counts(obs: DataFrame) -> DataFrame:
    """One row: records (food, text, comments, grade), those with a named food, with a text alone, with neither, with comments, and those that need identification."""
    named, text = F.col("food").isNotNull(), F.col("text").isNotNull()
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return obs.agg(F.count("*").alias("obs"), count(named).alias("named"), count(~named & text).alias("text_only"), count(~named & ~text).alias("empty"), count(F.col("comments") > 0).alias("with_comments"), count(F.col("grade") == "needs_id").alias("needs_id"))


def progress(obs: DataFrame, today: str) -> DataFrame:
    """One row a day: records (taxon, food, kind), those whose food is a species and those whose isn't, and different pairs of eater and eaten of which both are species."""
    named, species = F.col("food").isNotNull(), lambda c: F.contains(F.col(c), F.lit(" "))
    pair = F.when(named & species("food") & species("taxon"), F.when(F.col("kind") == "eating", F.struct(F.col("taxon").alias("a"), F.col("food").alias("b"))).otherwise(F.struct(F.col("food").alias("a"), F.col("taxon").alias("b"))))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return obs.agg(F.count("*").alias("n_obs"), count(named & species("food")).alias("n_named_species"), count(named & ~species("food")).alias("n_coarse"), F.count_distinct(pair).alias("n_green_edges")).select(F.lit(today).alias("date"), "*")


def nearest_reference(rows: DataFrame, reference: DataFrame, block: int = 4096) -> DataFrame:
    """(id, cos): the greatest cosine of each row (id, grp, v) to a reference (grp, v) of its group; no row for a group without references.

    Blocks of a group's rows meet blocks of its references in one task, in strips of the rows, which leaves a number a row; equal references are one.
    """
    reference = reference.select("grp", "v").distinct()
    a = rows.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("_a"))
    size = a.join(reference.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("_b")), "grp")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    q = rows.select("grp", "id", "v").join(size, "grp").withColumn("qb", F.pmod(F.xxhash64("id"), F.col("_a")).cast("int")).withColumn("cb", upto("_b"))
    c = reference.select("grp", "v").join(size, "grp").withColumn("cb", F.pmod(F.xxhash64("v"), F.col("_b")).cast("int")).withColumn("qb", upto("_a"))
    c = c.select(F.col("grp").alias("_grp"), F.col("qb").alias("_qb"), F.col("cb").alias("_cb"), F.col("v").alias("r"))

    def met(own: pa.Table, refs: pa.Table) -> pa.Table:
        if not own.num_rows or not refs.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.float64())], ["id", "cos"])
        v, r = unit_rows(own.column("v").combine_chunks()), unit_rows(refs.column("r").combine_chunks()).T
        best = np.concatenate([(v[i : i + STRIP] @ r).max(1) for i in range(0, len(v), STRIP)])
        return pa.Table.from_arrays([own.column("id").cast(pa.int64()), pa.array(best)], ["id", "cos"])

    found = q.select("grp", "qb", "cb", "id", "v").groupBy("grp", "qb", "cb").cogroup(c.groupBy("_grp", "_qb", "_cb")).applyInArrow(met, "id long, cos double")
    return found.groupBy("id").agg(F.max("cos").alias("cos"))


def novelty_order(pool: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, grp, novelty, place): each group's records (id, grp, v, created_at), least like any reference (grp, v) of the group first, then newest, then greater id; records without a vector, and groups without references, follow by recency.

    novelty is 1 less the greatest cosine, 0 at least. Vectors of one length; zero ones are an error.
    """
    near = nearest_reference(pool.where("v is not null"), reference)
    d = pool.select("id", "grp", "created_at").join(near, "id", "left").withColumn("novelty", F.greatest(1 - F.col("cos"), F.lit(0.0)))
    order = [F.round("novelty", 9).desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("id").desc()]
    return ranked(d.select("id", "grp", "created_at", "novelty"), ["grp"], order, "place").select("id", "grp", "novelty", "place")


def separability(rows: DataFrame) -> DataFrame:
    """One row (separability_pct, n): of labelled rows (id, label, v) the share whose nearest other labelled row has their label, in percent, and their number. A null or empty label is none."""
    some = rows.where("label is not null and cast(label as string) <> '' and v is not null")
    own = some.select("id", "label")
    near = exact_neighbours(some, some, 1).join(own, "id").join(own.withColumnsRenamed({"id": "nb", "label": "_other"}), "nb")
    hit = near.agg(F.count_if(F.col("label") == F.col("_other")).alias("_hit"), F.count("*").alias("n"))
    return hit.select((100 * F.try_divide("_hit", "n")).alias("separability_pct"), "n")
