"""First identifications, what others made of them, and the tables over both.

Records are rows (id, grp, quality, ct: community taxon, created_at, observer_idents). Identifications are rows
(id, seq, own, current, vision, created_at, taxon, anc: the taxon's ancestors, rank, user_idents).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bins of experience, and the levels in their order.
EXPERIENCE = ("<10 ids", "10-99 ids", "100-999 ids", "1000+ ids")
LEVELS = ("none", "easy", "taxonomist", "narrow", "weird", "mislabel")


def experience(n: Column) -> Column:
    """The bin of a number of identifications; unknown is none."""
    n = F.coalesce(n, F.lit(0))
    return F.when(n < 10, EXPERIENCE[0]).when(n < 100, EXPERIENCE[1]).when(n < 1000, EXPERIENCE[2]).otherwise(EXPERIENCE[3])


def level_number(level: Column) -> Column:
    """A level's number from its name, or from the number as text; anything else is null."""
    named = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level) - 1
    return F.when(named >= 0, named).otherwise(level.try_cast("int")).cast("int")


def on_lineage(taxon: Column, anc: Column, other: Column, other_anc: Column) -> Column:
    """Whether a taxon is the other, one of its descendants or one of its ancestors."""
    return (taxon == other) | F.array_contains(anc, other) | F.array_contains(other_anc, taxon)


def quarter(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def first_own(idents: DataFrame) -> DataFrame:
    """(id, first): the observer's earliest dated identification of each record."""
    own = idents.where(F.col("own") & F.col("created_at").isNotNull())
    return own.groupBy("id").agg(F.min(F.struct("created_at", "seq", "taxon", "anc", "rank", "vision")).alias("first"))


def others(idents: DataFrame) -> DataFrame:
    """Identifications by others that stand."""
    return idents.where(~F.col("own") & F.col("current"))


def scored(records: DataFrame, idents: DataFrame) -> DataFrame:
    """(id, grp, source, species, tested, overturned, first_taxon, experience, quarter) of every record that isn't casual and whose first own identification says whether it was suggested.

    Tested: to species, and others have identified the record. Overturned: tested, and the community's taxon is
    neither the first taxon nor, by another's identification, one of its descendants.
    """
    first = first_own(idents)
    o = others(idents).join(first, "id").join(records.select("id", "ct"), "id")
    holds = (F.col("taxon") == F.col("ct")) & ((F.col("taxon") == F.col("first.taxon")) | F.array_contains("anc", F.col("first.taxon")))
    o = o.groupBy("id").agg(F.count("*").alias("others"), F.max(F.coalesce(holds, F.lit(False))).alias("upheld"))
    r = records.where("quality <> 'casual'").dropDuplicates(["id"]).join(first, "id").where("first.vision is not null").join(o, "id", "left")
    species = F.col("first.rank") == "species"
    tested = species & F.coalesce(F.col("others") > 0, F.lit(False))
    over = tested & F.col("ct").isNotNull() & ~(F.coalesce(F.col("ct") == F.col("first.taxon"), F.lit(False)) | F.coalesce("upheld", F.lit(False)))
    return r.select("id", F.coalesce("grp", F.lit("unknown")).alias("grp"), F.when(F.col("first.vision"), "cv").otherwise("typed").alias("source"), species.alias("species"), tested.alias("tested"), over.alias("overturned"), F.col("first.taxon").alias("first_taxon"), experience(F.col("observer_idents")).alias("experience"), quarter(F.col("created_at")).alias("quarter"))


def matched_table(rows: DataFrame, by: str) -> DataFrame:
    """Per stratum that has both sources: tested records, the crude ratio of typed to suggested overturn, the ratio matched by first taxon (Mantel-Haenszel), and the taxa that have both."""
    t = rows.where("tested")
    n = lambda s: F.count_if(F.col("source") == s)
    over = lambda s: F.count_if((F.col("source") == s) & F.col("overturned"))
    by_taxon = t.groupBy(by, "first_taxon").agg(n("cv").alias("nc"), n("typed").alias("nt"), over("cv").alias("oc"), over("typed").alias("ot"))
    both, whole = (F.col("nc") > 0) & (F.col("nt") > 0), F.col("nc") + F.col("nt")
    when = lambda x: F.sum(F.when(both, x))
    out = by_taxon.groupBy(by).agg(F.sum(whole).alias("tested"), F.try_divide(F.sum("ot") / F.sum("nt"), F.try_divide(F.sum("oc"), F.sum("nc"))).alias("crude"), F.try_divide(when(F.col("ot") * F.col("nc") / whole), when(F.col("oc") * F.col("nt") / whole)).alias("matched"), F.count_if(both).alias("species"), F.sum("nc").alias("_c"), F.sum("nt").alias("_t"))
    return out.where("_c > 0 and _t > 0").select(F.col(by).alias("stratum"), "tested", "crude", "matched", "species")


def other_ids(rows: DataFrame, idents: DataFrame) -> DataFrame:
    """(id, seq, source, same, vision, experience): the others' standing identifications of tested records, and whether each is on the first taxon's lineage."""
    o = others(idents).join(rows.where("tested").select("id", "source"), "id").join(first_own(idents), "id")
    same = on_lineage(F.col("taxon"), F.col("anc"), F.col("first.taxon"), F.col("first.anc"))
    return o.select("id", "seq", "source", same.alias("same"), F.coalesce("vision", F.lit(False)).alias("vision"), experience(F.col("user_idents")).alias("experience"))


def identifier_cv(other: DataFrame) -> DataFrame:
    """Per source: the others' identifications on the first taxon's lineage and off it, and the share of each that was suggested."""
    share = lambda c: F.avg(F.when(c, F.col("vision").cast("double")))
    return other.groupBy("source").agg(F.count_if("same").alias("same"), share(F.col("same")).alias("same_cv"), F.count_if(~F.col("same")).alias("other"), share(~F.col("same")).alias("other_cv"))


def corrector(other: DataFrame) -> DataFrame:
    """Per source and experience: the others' identifications, and those off the first taxon's lineage."""
    g = other.groupBy("source", "experience").agg(F.count("*").alias("ids"), F.count_if(~F.col("same")).alias("other"))
    return g.withColumn("other_share", F.col("other") / F.col("ids"))


def delays(rows: DataFrame, idents: DataFrame, least_age: int = 365) -> DataFrame:
    """(id, source, days): days from the first own identification to the first correction, of overturned records that are old enough to show a late one.

    A correction is another's standing identification off the first taxon's lineage. Ages run to the latest
    identification of all.
    """
    end = idents.agg(F.max("created_at").alias("end"))
    o = others(idents).where("created_at is not null").join(rows.where("overturned").select("id", "source"), "id").join(first_own(idents), "id")
    days = (F.unix_timestamp("created_at") - F.unix_timestamp("first.created_at")) / 86400
    o = o.where(~on_lineage(F.col("taxon"), F.col("anc"), F.col("first.taxon"), F.col("first.anc"))).withColumn("days", days).where("days >= 0")
    o = o.groupBy("id", "source").agg(F.min("days").alias("days"), F.min("first.created_at").alias("at")).join(F.broadcast(end))  # one row
    return o.where(F.floor((F.unix_timestamp("end") - F.unix_timestamp("at")) / 86400) >= least_age).select("id", "source", "days")


def level_contradiction(levels: DataFrame, idents: DataFrame) -> DataFrame:
    """Per level: records, the share that others have identified, and of those the share where one of them is off the lineage of the taxon that the level was given for. levels: rows (id, level, taxon_id)."""
    known = idents.select("id", F.col("taxon").alias("taxon_id"), F.col("anc").alias("label_anc")).groupBy("id", "taxon_id").agg(F.min("label_anc").alias("label_anc"))
    o = others(idents).join(levels, "id").join(known, ["id", "taxon_id"], "left")
    off = ~on_lineage(F.col("taxon"), F.col("anc"), F.col("taxon_id"), F.coalesce("label_anc", F.array().cast("array<string>")))
    o = o.groupBy("id").agg(F.max(off).alias("off"))
    g = levels.join(o, "id", "left").groupBy("level").agg(F.count("*").alias("n"), F.count("off").alias("_o"), F.count_if("off").alias("_c"))
    return g.select("level", "n", (F.col("_o") / F.col("n")).alias("has_other"), F.try_divide("_c", "_o").alias("contradicted"))


def days_to_research(idents: DataFrame, start: Column) -> DataFrame:
    """(id, days): days from `start` until a record has research grade by its identifications so far: two or more at the end on one species that more than two thirds agree on. Null if never.

    Each person's latest identification counts; the running number for each answer is a window over the record's own
    identifications.
    """
    per = Window.partitionBy("id").orderBy("created_at", "seq")
    x = idents.withColumn("sofar", F.collect_list(F.struct("user", "taxon")).over(per.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.map_values(F.aggregate("sofar", F.expr("cast(map() as map<string, string>)"), lambda m, v: F.map_concat(F.map_filter(m, lambda k, _: k != v["user"]), F.map_from_entries(F.array(F.struct(v["user"], v["taxon"]))))))
    x = x.withColumn("votes", last)
    best = F.array_max(F.transform(F.array_distinct("votes"), lambda t: F.size(F.filter("votes", lambda v: v == t))))
    done = (best >= 2) & (3 * best > 2 * F.size("votes")) & (F.col("created_at") >= start)
    days = (F.unix_timestamp("created_at") - F.unix_timestamp(start)) / 86400
    return x.groupBy("id").agg(F.min(F.when(done, days)).alias("days"))
