"""Queries of outcomes by level, totals, evidence, novelty and separability."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldqueue.operators import consensus, outcomes
from fieldqueue.plans.similarity import BASE, SCORES, answers, rows, scores, skene_sql
from fieldqueue.plans.views import POOL, pool
from fieldqueue.sources.tables import table


def settled(s, d):
    """Consensus of the answers by expectation-maximisation; N stands for an abstention and isn't a name."""
    c = consensus.consensus(answers(s, d)).withColumn("posterior", F.round("posterior", 4))
    c = c.withColumn("label", F.when(F.col("label") != "N", F.col("label")))
    n = answers(s, d).groupBy("record").agg(F.count_if(F.col("label") != "N").alias("n_answers"), F.count_if(F.col("label") == "N").alias("n_abstain"))
    t = outcomes.level_table(c, n, pool(s, d).select(F.col("id").alias("record"), F.col("grp").alias("level")), 0.6)
    return t.select("level", "n", *[F.round(x, 6).alias(x) for x in ("settled", "posterior", "abstain")])


def leveled(s, d):
    level = F.when(F.col("margin") < 0, "mislabel").when(F.col("margin") < 0.05, "narrow").otherwise("easy")
    return scores(s, d).where("own is not null").withColumn("level", level)


def name(c):
    return F.concat(F.lit("g"), F.floor(c / 3).cast("string"), F.lit(" s"), c.cast("string"))


def cohort(s, d):
    x = leveled(s, d)
    k, lab, other = F.col("id"), F.col("label"), F.col("other_label")
    before = x.select("id", "level", lab.alias("taxon_id"), name(other).alias("other_name"))
    now = F.when(k % 4 == 0, other).when(k % 5 == 0, (lab + 1) % 10).otherwise(lab)
    after = x.where(k % 6 != 0).select("id", now.alias("taxon_id"), name(now).alias("name"))
    left = x.where(k % 12 == 0).select("id", ((lab + k % 5) % 10).cast("int").alias("taxon_id"))
    c = outcomes.cohort(before, after, x.where(k % 11 == 0), left)
    flags = ("left", "corrected", "changed_any", "to_suggested", "to_suggested_genus")
    return c.groupBy("level").agg(F.count("*").alias("n"), *[F.count_if(f).alias(f) for f in flags])


def described(s, d):
    x = leveled(s, d).withColumn("grp", F.when(F.col("grp") > 0, F.concat(F.lit("g"), F.col("grp").cast("string"))))
    out = outcomes.described(x, x.select("id", "grp", "level"), [0.01, 0.25, 0.5, 0.9])
    return out.withColumn("value", F.round("value", 6))


def over(s, d):
    p = pool(s, d).select(F.when(F.col("id") % 9 != 0, F.col("grp")).alias("grp"), F.when(F.col("id") % 7 != 0, F.date_sub("created_at", 40)).alias("observed_on"), "created_at", "id")
    month = F.trunc("created_at", "MM").alias("month")
    t = p.where("id % 10 < 5").groupBy(F.coalesce("grp", F.lit("Unknown")).alias("grp"), month).agg((2 * F.count("*")).alias("total"))
    totals = t.select(F.lit("up").alias("kind"), "grp", "month", "total").unionByName(t.select(F.lit("obs").alias("kind"), "grp", "month", "total"))
    return outcomes.over_totals(p, totals, "1993-01-01")


def evidence(s, d):
    """Orders as feeding records."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    taxon = lambda x, p: F.when(x % 4 == 0, F.concat(F.lit(p), (x % 30).cast("string"))).otherwise(F.concat(F.lit(f"{p} s"), (x % 30).cast("string")))
    grade = F.when(F.col("o_orderstatus") == "O", "needs_id").otherwise("research")
    return table(s, d, "orders").select(taxon(c, "eater").alias("taxon"), F.when(k % 3 != 0, taxon(k, "food")).alias("food"), F.when(k % 5 != 0, "text").alias("text"), (k % 4).alias("comments"), grade.alias("grade"), F.when(k % 2 == 0, "eating").otherwise("eaten").alias("kind"))


def novelty(s, d):
    r = rows(s, d)
    p = r.where("id % 2 = 1").select("id", (F.col("id") % 4).alias("grp"), F.when(F.col("id") % 9 != 0, F.col("v")).alias("v"), F.timestamp_seconds(F.col("id") % 50).alias("created_at"))
    ref = r.where("id % 2 = 0 and id % 8 <> 2").select((F.col("id") % 8 / 2).cast("long").alias("grp"), "v")
    return outcomes.novelty_order(p, ref).withColumn("novelty", F.round("novelty", 6))


def separable(s, d):
    r = rows(s, d).withColumn("label", F.when(F.col("id") % 10 != 3, F.col("label")))
    return outcomes.separability(r).withColumn("separability_pct", F.round("separability_pct", 6))


QUERIES = {
    "level_table": settled,
    "cohort_levels": cohort,
    "describe_levels": described,
    "over_totals": over,
    "foodobs_counts": lambda s, d: outcomes.evidence_counts(evidence(s, d)),
    "foodweb_progress": lambda s, d: outcomes.progress(evidence(s, d), "2026-01-02"),
    "order_novelty": novelty,
    "separability": separable,
}
LEVELED = f"""{SCORES}, lv as (select *, case when margin < 0 then 'mislabel' when margin < 0.05 then 'narrow' else 'easy' end "level" from sc where own is not null)"""
EVIDENCE = """ob as (select case when o_custkey % 4 = 0 then 'eater' || (o_custkey % 30) else 'eater s' || (o_custkey % 30) end taxon, case when o_orderkey % 3 <> 0 then case when o_orderkey % 4 = 0 then 'food' || (o_orderkey % 30) else 'food s' || (o_orderkey % 30) end end food,
    o_orderkey % 5 <> 0 txt, o_orderkey % 4 comments, o_orderstatus = 'O' needs, o_orderkey % 2 = 0 eats from orders)"""
ORACLE = {
    "level_table": f"""with {POOL}, ds as ({skene_sql(10)}), n as (select l_orderkey record, count(*) filter (l_returnflag <> 'N') a, count(*) filter (l_returnflag = 'N') b from lineitem group by 1)
        select grp "level", count(*) n, round(avg((posterior >= 0.6 and "label" <> 'N')::INT), 6) settled, round(avg(posterior), 6) posterior, round(avg(b / (a + b)), 6) abstain from ds join n using (record) join pool on id = record group by 1""",
    "cohort_levels": f"""with {LEVELED}, x as (select id, "level", "label" t, other_label o, case when id % 6 <> 0 then case when id % 4 = 0 then other_label when id % 5 = 0 then ("label" + 1) % 10 else "label" end end nw, case when id % 12 = 0 then ("label" + id % 5) % 10 end gn from lv),
        un as (select distinct nw from x where nw is not null), y as (select *, nw is null lft, coalesce(nw <> t, false) ch, t in (select nw from un) used from x where id % 11 <> 0)
        select "level", count(*) n, count(*) filter (lft) "left", count(*) filter (ch and used) corrected, count(*) filter ((ch or (lft and coalesce(gn <> t, false))) and used) changed_any, count(*) filter (ch and used and nw = o) to_suggested, count(*) filter (ch and used and nw // 3 = o // 3) to_suggested_genus from y group by 1""",
    "describe_levels": f"""with {LEVELED}, x as (select *, case when grp > 0 then 'g' || grp else '' end g from lv), ev as (select 'margin' what, margin x from x union all select 'own', own from x union all select 'top', top from x), q as (select unnest([0.01, 0.25, 0.5, 0.9])::DOUBLE q)
        select what, null grp, null "level", q.q, round(quantile_cont(x, [0.01, 0.25, 0.5, 0.9])[list_position([0.01, 0.25, 0.5, 0.9]::DOUBLE[], q.q)], 6) "value" from ev, q group by what, q.q
        union all select 'weird cut', g, null, 0.02, round(quantile_cont(top, 0.02), 6) from x group by g union all select 'close cut', g, null, 0.25, round(quantile_cont(margin, 0.25), 6) from x where margin < 0 group by g
        union all select 'rows', g, "level", null, count(*) from x group by g, "level\"""",
    "over_totals": f"""with {POOL}, p as (select id, case when id % 9 <> 0 then grp end grp, case when id % 7 <> 0 then created_at::DATE - 40 end ob, created_at::DATE up from pool), t as (select coalesce(grp, 'Unknown') grp, date_trunc('month', up)::DATE "month", 2 * count(*) total from p where id % 10 < 5 group by 1, 2),
        k as (select 'obs' kind, coalesce(grp, 'Unknown') grp, ob dy from p union all select 'up', coalesce(grp, 'Unknown'), up from p), n as (select kind, grp, date_trunc('month', greatest(dy, date '1993-01-01'))::DATE "month", count(*) n from k where dy is not null group by 1, 2, 3)
        select kind, grp, "month", n, total from n join t using (grp, "month") where n > total""",
    "foodobs_counts": f"with {EVIDENCE} select count(*) obs, count(food) named, count(*) filter (food is null and txt) text_only, count(*) filter (food is null and not txt) empty, count(*) filter (comments > 0) with_comments, count(*) filter (needs) needs_id from ob",
    "foodweb_progress": f"with {EVIDENCE} select '2026-01-02' \"date\", count(*) n_obs, count(*) filter (contains(food, ' ')) n_named_species, count(*) filter (not contains(food, ' ')) n_coarse, count(distinct case when contains(food, ' ') and contains(taxon, ' ') then case when eats then taxon || '|' || food else food || '|' || taxon end end) n_green_edges from ob",
    "order_novelty": f"""with {BASE}, p as (select id, id % 4 grp, case when id % 9 <> 0 then v end v, id % 50 at_ from r where id % 2 = 1), f as (select id % 8 // 2 grp, v from r where id % 2 = 0 and id % 8 <> 2),
        x as (select p.id, max(list_cosine_similarity(p.v, f.v)) c from p join f using (grp) where p.v is not null group by 1), y as (select p.id, grp, at_, greatest(1 - c, 0) nv from p left join x using (id))
        select id, grp, round(nv, 6) novelty, row_number() over (partition by grp order by round(nv, 9) desc nulls last, at_ desc, id desc) - 1 place from y""",
    "separability": f"""with {BASE}, l as (select * from r where id % 10 <> 3), x as (select a.id, a."label" = b."label" hit, row_number() over (partition by a.id order by round(list_cosine_similarity(a.v, b.v), 12) desc, b.id) k from l a, l b where a.id <> b.id) select round(100 * avg(hit::INT), 6) separability_pct, count(*) n from x where k = 1""",
}
