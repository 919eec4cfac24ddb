"""Queries of first identifications and what others made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldqueue.operators import overturn
from fieldqueue.sources.tables import table


def idents(s, d):
    li = table(s, d, "lineitem")
    deep = F.col("l_linenumber") % 4 != 0
    none = F.array().cast("array<string>")
    return li.select(
        F.col("l_orderkey").alias("id"),
        (F.col("l_linenumber").cast("long") * 10**12 + F.col("l_partkey") * 10**5 + F.col("l_suppkey")).alias("seq"),
        (F.col("l_linenumber") % 3 == 1).alias("own"),
        (F.col("l_linenumber") % 5 != 0).alias("current"),
        F.when(F.col("l_tax") < 0.03, True).when(F.col("l_tax") < 0.07, False).alias("vision"),
        F.col("l_shipdate").alias("created_at"),
        F.when(deep, F.concat("l_returnflag", "l_linestatus")).otherwise(F.col("l_returnflag")).alias("taxon"),
        F.when(deep, F.array("l_returnflag")).otherwise(none).alias("anc"),
        F.when(deep, "species").otherwise("genus").alias("rank"),
        F.when(F.col("l_suppkey") % 13 != 0, F.col("l_suppkey") * 7 % 1500).alias("user_idents"),
        F.concat(F.lit("u"), F.col("l_suppkey") % 3).alias("user"),
    )


def records(s, d):
    top = idents(s, d).where("current").groupBy("id", "taxon").agg(F.count("*").alias("n"))
    ct = top.groupBy("id").agg(F.max(F.struct("n", "taxon")).alias("b")).where("b.n >= 2").select("id", F.col("b.taxon").alias("ct"))
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("grp"), F.when(F.col("o_orderkey") % 9 == 0, "casual").otherwise("needs_id").alias("quality"), F.col("o_orderdate").alias("created_at"), (F.col("o_custkey") % 1200).alias("observer_idents"))
    return o.join(ct, "id", "left")


def scored(s, d):
    return overturn.scored(records(s, d), idents(s, d))


def other(s, d):
    return overturn.other_ids(scored(s, d), idents(s, d))


def levels(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*map(F.lit, overturn.LEVELS)), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("level"), F.when(F.col("o_orderkey") % 2 == 0, "NO").otherwise("RF").alias("taxon_id"))


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def lineage_test(s, d):
    i = idents(s, d).join(overturn.first_own(idents(s, d)), "id")
    return i.select("id", "seq", overturn.on_lineage(F.col("taxon"), F.col("anc"), F.col("first.taxon"), F.col("first.anc")).alias("on_lineage"))


QUERIES = {
    "overturn_scored": scored,
    "matched_table": lambda s, d: rounded(overturn.matched_table(scored(s, d), "quarter"), "crude", "matched"),
    "other_ids": other,
    "identifier_cv": lambda s, d: rounded(overturn.identifier_cv(other(s, d)), "same_cv", "other_cv"),
    "corrector": lambda s, d: rounded(overturn.corrector(other(s, d)), "other_share"),
    "delays": lambda s, d: rounded(overturn.delays(scored(s, d), idents(s, d)), "days"),
    "level_contradiction": lambda s, d: rounded(overturn.level_contradiction(levels(s, d), idents(s, d)), "has_other", "contradicted"),
    "on_lineage": lineage_test,
    "level_number": lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("id"), overturn.level_number(F.when(F.col("p_size") % 2 == 0, F.element_at(F.array(*map(F.lit, overturn.LEVELS)), F.col("p_size") % 6 + 1)).when(F.col("p_size") % 5 == 0, F.col("p_brand")).otherwise((F.col("p_size") % 6).cast("string"))).alias("level")),
    "quarter": lambda s, d: table(s, d, "orders").groupBy(overturn.quarter(F.col("o_orderdate")).alias("quarter")).agg(F.count("*").alias("n")),
    "bins": lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("id"), overturn.experience(F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") * 37 % 2000)).alias("experience")),
    "win_days_to_rg": lambda s, d: rounded(overturn.days_to_research(idents(s, d), F.lit("1994-01-01").cast("timestamp")), "days"),
}

BIN = "case when coalesce({0}, 0) < 10 then '<10 ids' when coalesce({0}, 0) < 100 then '10-99 ids' when coalesce({0}, 0) < 1000 then '100-999 ids' else '1000+ ids' end"
NAMES = "['none', 'easy', 'taxonomist', 'narrow', 'weird', 'mislabel']"
I = """i as (select l_orderkey id, l_linenumber::BIGINT * 1000000000000 + l_partkey * 100000 + l_suppkey seq, l_linenumber % 3 = 1 own, l_linenumber % 5 <> 0 cur, case when l_tax < 0.03 then true when l_tax < 0.07 then false end vision, l_shipdate created_at,
    case when l_linenumber % 4 <> 0 then l_returnflag || l_linestatus else l_returnflag end taxon, case when l_linenumber % 4 <> 0 then [l_returnflag] else []::VARCHAR[] end anc, case when l_linenumber % 4 <> 0 then 'species' else 'genus' end rank,
    case when l_suppkey % 13 <> 0 then l_suppkey * 7 % 1500 end user_idents, 'u' || (l_suppkey % 3) "user" from lineitem),
    f as (select id, min((created_at, seq, taxon, anc, rank, coalesce(vision::INT, -1))) k from i where own and created_at is not null group by 1), fo as (select id, k[1] f_at, k[3] f_taxon, k[4] f_anc, k[5] f_rank, case k[6] when 1 then true when 0 then false end f_vision from f),
    o as (select * from i where not own and cur)"""
SC = I + f""", tp as (select id, taxon, count(*) n from i where cur group by 1, 2), ct as (select id, max((n, taxon)) b from tp group by 1), r as (select o_orderkey id, o_orderpriority grp, case when o_orderkey % 9 = 0 then 'casual' else 'needs_id' end quality, o_orderdate created_at, o_custkey % 1200 observer_idents, case when b[1] >= 2 then b[2] end ct from orders left join ct on id = o_orderkey),
    h as (select o.id, count(*) others, bool_or(coalesce(taxon = ct and (taxon = f_taxon or list_contains(anc, f_taxon)), false)) upheld from o join fo using (id) join r using (id) group by 1),
    sc as (select r.id, grp, case when f_vision then 'cv' else 'typed' end source, f_rank = 'species' species, f_rank = 'species' and coalesce(others > 0, false) tested,
        f_rank = 'species' and coalesce(others > 0, false) and ct is not null and not (coalesce(ct = f_taxon, false) or coalesce(upheld, false)) overturned, f_taxon first_taxon, {BIN.format('observer_idents')} experience, year(r.created_at) || 'Q' || quarter(r.created_at) "quarter"
        from r join fo using (id) left join h using (id) where quality <> 'casual' and f_vision is not null)"""
ON = "(taxon = f_taxon or list_contains(anc, f_taxon) or list_contains(f_anc, taxon))"
OI = SC + f", oi as (select o.id, seq, source, {ON} same, coalesce(vision, false) vision, {BIN.format('user_idents')} experience from o join sc using (id) join fo using (id) where tested)"
ORACLE = {
    "overturn_scored": f"with {SC} select * from sc",
    "matched_table": f"""with {SC}, t as (select "quarter", first_taxon, count(*) filter (source = 'cv') nc, count(*) filter (source = 'typed') nt, count(*) filter (source = 'cv' and overturned) oc, count(*) filter (source = 'typed' and overturned) ot from sc where tested group by 1, 2)
        select "quarter" stratum, sum(nc + nt)::BIGINT tested, round((sum(ot) / sum(nt)) / nullif(sum(oc) / sum(nc), 0), 6) crude, round(sum(ot * nc / (nc + nt)) filter (nc > 0 and nt > 0) / nullif(sum(oc * nt / (nc + nt)) filter (nc > 0 and nt > 0), 0), 6) matched, count(*) filter (nc > 0 and nt > 0) species from t group by 1 having sum(nc) > 0 and sum(nt) > 0""",
    "other_ids": f"with {OI} select * from oi",
    "identifier_cv": f"with {OI} select source, count(*) filter (same) same, round(avg(vision::INT) filter (same), 6) same_cv, count(*) filter (not same) other, round(avg(vision::INT) filter (not same), 6) other_cv from oi group by 1",
    "corrector": f"with {OI} select source, experience, count(*) ids, count(*) filter (not same) other, round(count(*) filter (not same) / count(*), 6) other_share from oi group by 1, 2",
    "delays": f"""with {SC}, x as (select o.id, source, (epoch(created_at) - epoch(f_at)) / 86400 "days", f_at from o join sc using (id) join fo using (id) where overturned and not {ON}), m as (select id, source, min("days") "days", min(f_at) f_at from x where "days" >= 0 group by 1, 2)
        select id, source, round("days", 6) "days" from m where floor((epoch((select max(created_at) from i)) - epoch(f_at)) / 86400) >= 365""",
    "level_contradiction": f"""with {I}, l as (select o_orderkey id, ({NAMES})[o_orderkey % 6 + 1] "level", case when o_orderkey % 2 = 0 then 'NO' else 'RF' end taxon_id from orders), kn as (select id, taxon taxon_id, min(anc) label_anc from i group by 1, 2),
        c as (select o.id, bool_or(not (taxon = taxon_id or list_contains(anc, taxon_id) or list_contains(coalesce(label_anc, []), taxon))) off_ from o join l using (id) left join kn using (id, taxon_id) group by 1)
        select "level", count(*) n, round(count(off_) / count(*), 6) has_other, round(count(*) filter (off_) / nullif(count(off_), 0), 6) contradicted from l left join c using (id) group by 1""",
    "on_lineage": f"with {I} select id, seq, {ON} on_lineage from i join fo using (id)",
    "level_number": f"select p_partkey id, (case when p_size % 2 = 0 then list_position({NAMES}, ({NAMES})[p_size % 6 + 1]) - 1 when p_size % 5 = 0 then null else p_size % 6 end)::INT \"level\" from part",
    "quarter": "select year(o_orderdate) || 'Q' || quarter(o_orderdate) \"quarter\", count(*) n from orders group by 1",
    "bins": f"select c_custkey id, {BIN.format('case when c_custkey % 7 <> 0 then c_custkey * 37 % 2000 end')} experience from customer",
    "win_days_to_rg": f"""with {I}, a as (select i.id, i.created_at, i.seq, j."user", arg_max(j.taxon, (j.created_at, j.seq)) taxon from i join i j on i.id = j.id and (j.created_at, j.seq) <= (i.created_at, i.seq) group by 1, 2, 3, 4),
        n as (select id, created_at, seq, taxon, count(*) n from a group by 1, 2, 3, 4), t as (select id, created_at, max(n) best, sum(n) votes from n group by id, created_at, seq)
        select id, round(min((epoch(created_at) - epoch(timestamp '1994-01-01')) / 86400) filter (best >= 2 and 3 * best > 2 * votes and created_at >= timestamp '1994-01-01'), 6) "days" from t group by 1""",
}
