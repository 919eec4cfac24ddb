"""Queries of the analysis of served records."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldqueue.operators import analysis
from fieldqueue.plans.batching import ARMS
from fieldqueue.plans.views import IDENTS, PAIRS, POOL, SERVED, WINDOW, idents, pool, served



def window():
    return tuple(F.lit(x).cast("timestamp") for x in WINDOW)


def pairs(s, d):
    return analysis.counted_pairs(idents(s, d), served(s, d), *window(), ["species", "genus"])


def participants(s, d):
    return idents(s, d).where("user_id % 2 = 0").select("user_id").distinct()


def scored(s, d):
    """Each record's first own identification: by source, whether others tested it, and whether they overturned it."""
    i = idents(s, d)
    first = i.groupBy("id").agg(F.min_by("answer", F.struct("created_at", "seq", "answer")).alias("first"), F.min(F.struct("created_at", "seq", "answer")).alias("at"))
    other = i.join(first, "id").where(F.struct("created_at", "seq", "answer") > F.col("at")).groupBy("id").agg(F.count("*").alias("others"), F.count_if(F.col("answer") != F.col("first")).alias("against"), F.min("created_at").alias("next"))
    r = pool(s, d).join(first, "id").join(other, "id", "left")
    return r.select("id", "grp", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.coalesce(F.col("others") > 0, F.lit(False)).alias("tested"), F.coalesce(2 * F.col("against") > F.col("others"), F.lit(False)).alias("overturned"), F.col("at.created_at").alias("first_at"), "next", F.concat(F.year("at.created_at"), F.lit("Q"), F.quarter("at.created_at")).alias("quarter"))


SCORED = f"""{POOL}, {IDENTS}, f as (select id, arg_min(answer, (created_at, seq, answer)) "first", min((created_at, seq, answer)) at_ from idents group by 1),
o as (select i.id, count(*) others, count(*) filter (answer <> "first") against, min(created_at) "next" from idents i join f using (id) where (created_at, seq, answer) > at_ group by 1),
scored as (select p.id, grp, case when p.id % 2 = 0 then 'a' else 'b' end source, coalesce(others > 0, false) tested, coalesce(2 * against > others, false) overturned, at_[1] first_at, "next",
    year(at_[1]) || 'Q' || quarter(at_[1]) "quarter" from pool p join f using (id) left join o using (id))"""


def analysis_auc(s, d):
    return analysis.rank_auc(pool(s, d).select("score", (F.col("status") == "F").cast("int").alias("y"))).select(F.round("auc", 6).alias("auc"), "positives")


def delay_hours(s, d):
    hours = (F.unix_timestamp("next") - F.unix_timestamp("first_at")) / 3600
    return scored(s, d).where("tested").withColumn("h", hours).groupBy("source", "overturned").agg(F.count("*").alias("n"), F.round(F.percentile("h", F.lit(0.5)), 6).alias("median_h"), F.round(F.avg((F.col("h") <= 24).cast("double")), 6).alias("within_day"))


def delay_shares(s, d):
    days = F.datediff("next", "first_at")
    return scored(s, d).where("tested and overturned").withColumn("days", days).groupBy("source").agg(F.count("*").alias("n"), *[F.round(F.avg((F.col("days") <= h).cast("double")), 6).alias(f"d{h}") for h in (1, 7, 30, 90, 365)])


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def cv_error(s, d):
    """Error by group and source and over all groups, with score interval and correction."""
    r = scored(s, d).where("tested")
    g = r.unionByName(r.withColumn("grp", F.lit("all"))).groupBy("grp", "source").agg(F.count("*").alias("n"), F.count_if("overturned").alias("wrong"))
    lo, hi = analysis.wilson(F.col("wrong"), F.col("n"))
    share = F.col("wrong") / F.col("n")
    return rounded(g.select("grp", "source", "n", "wrong", lo.alias("lo"), hi.alias("hi"), analysis.corrected_share(share, F.lit(0.02)).alias("error")), "lo", "hi", "error")


def holm_family(s, d):
    t = scored(s, d).groupBy("grp").agg(F.avg(F.col("overturned").cast("double")).alias("p")).select(F.col("grp").alias("name"), F.round(F.col("p") / 10, 8).alias("p"))
    return rounded(analysis.holm(t), "adjusted", digits=8)


def joined_outcomes(s, d):
    n = idents(s, d).groupBy("id").agg(F.count("*").alias("n_idents"))
    return served(s, d).join(pool(s, d).select("id", "status"), "id", "left").join(n, "id", "left")


def exposure(s, d):
    seen = idents(s, d).groupBy("id").agg(F.collect_set("user_id").alias("reviewed_by"))
    return seen.select("id", F.explode("reviewed_by").alias("user_id"))


QUERIES = {
    "agg_conflict": lambda s, d: analysis.one_arm(served(s, d)),
    "agg_pairs": lambda s, d: analysis.by_arm(pairs(s, d), served(s, d).select("id", "arm"), ARMS),
    "agg_pairs_weighted": lambda s, d: rounded(analysis.by_arm(pairs(s, d), served(s, d).select("id", "arm", "score"), ARMS, "score"), *ARMS, digits=5),
    "participants": lambda s, d: analysis.counted_pairs(idents(s, d), served(s, d), *window(), ["species", "genus"], participants(s, d)),
    "record_totals": lambda s, d: analysis.record_totals(pairs(s, d), served(s, d).select("id", "arm")),
    "exposure": lambda s, d: analysis.by_arm(exposure(s, d), served(s, d).select("id", "arm"), ARMS),
    "exposure_summary": lambda s, d: rounded(analysis.exposure_summary(analysis.by_arm(exposure(s, d), served(s, d).select("id", "arm"), ARMS), ARMS), "share"),
    "outsiders": lambda s, d: analysis.outsiders(idents(s, d), served(s, d), participants(s, d), *window()),
    "outcomes": lambda s, d: rounded(analysis.outcomes(joined_outcomes(s, d)), "share_done", "share_two", "share_one", "score_done", digits=5),
    "dry_run": lambda s, d: joined_outcomes(s, d).groupBy("arm").agg(F.round(F.avg((F.coalesce("n_idents", F.lit(0)) <= 3).cast("double")), 6).alias("unengaged")),
    "overturn_table": lambda s, d: rounded(analysis.overturn_table(scored(s, d), "quarter"), "rate"),
    "mantel_haenszel": lambda s, d: rounded(analysis.mantel_haenszel(scored(s, d), "grp"), "ratio"),
    "latency": delay_hours,
    "delay_table": delay_shares,
    "cv_error": cv_error,
    "holm": holm_family,
    "auc": analysis_auc,
}

P = f"with {IDENTS}, {SERVED}, {PAIRS}"
COLS = ", ".join(f"count(*) filter (arm = '{a}') \"{a}\"" for a in ARMS)
SUMS = ", ".join(f"round(coalesce(sum(coalesce(score, 0)) filter (arm = '{a}'), 0), 5) \"{a}\"" for a in ARMS)
EXPO = f"with {IDENTS}, {SERVED}, e as (select distinct id, user_id from idents where user_id is not null), expo as (select user_id, {COLS} from e join served using (id) group by 1)"
WILSON = "1.959963984540054"
ORACLE = {
    "agg_conflict": f"with {SERVED} select id, arm, score from served",
    "agg_pairs": f"{P} select user_id, {COLS} from pairs join served using (id) group by 1",
    "agg_pairs_weighted": f"{P} select user_id, {SUMS} from pairs join served using (id) group by 1",
    "participants": f"{P} select user_id, id from pairs where user_id % 2 = 0",
    "record_totals": f"{P}, n as (select id, count(*) n from pairs group by 1) select id, arm, coalesce(n, 0) n from served left join n using (id)",
    "exposure": f"{EXPO} select * from expo",
    "exposure_summary": EXPO + ", l as (" + " union all ".join(f"select '{a}' arm, \"{a}\" n from expo" for a in ARMS) + "), t as (select arm, count(*) filter (n > 0) users, sum(n)::BIGINT total from l group by 1) select arm, users, total, round(total / (select sum(total) from t), 6) share from t",
    "outsiders": f"""with {IDENTS}, {SERVED}, f as (select id, min(created_at) filter (user_id % 2 = 0) part, min(created_at) filter (user_id % 2 <> 0) "out" from idents
        where created_at >= timestamp '{WINDOW[0]}' and created_at < timestamp '{WINDOW[1]}' and user_id is not null group by 1)
        select arm, count(*) n, count(*) filter ("out" is not null and (part is null or "out" < part)) lost from served left join f using (id) group by 1""",
    "outcomes": f"""with {POOL}, {IDENTS}, {SERVED}, n as (select id, count(*) n_idents from idents group by 1), j as (select arm, served.score, status, coalesce(n_idents, 0) k from served left join pool using (id) left join n using (id))
        select arm, count(*) n, round(avg((status = 'F')::INT), 5) share_done, round(avg((k >= 2)::INT), 5) share_two, round(avg((k <= 1)::INT), 5) share_one, round(sum(case when status = 'F' then coalesce(score, 0) else 0 end), 5) score_done from j group by 1""",
    "dry_run": f"with {IDENTS}, {SERVED}, n as (select id, count(*) n_idents from idents group by 1) select arm, round(avg((coalesce(n_idents, 0) <= 3)::INT), 6) unengaged from served left join n using (id) group by 1",
    "overturn_table": f"with {SCORED} select \"quarter\", source, count(*) n, count(*) filter (tested) tested, count(*) filter (tested and overturned) overturned, round(count(*) filter (tested and overturned) / nullif(count(*) filter (tested), 0), 6) rate from scored group by 1, 2",
    "mantel_haenszel": f"""with {SCORED}, s as (select grp, count(*) filter (source = 'a' and tested) na, count(*) filter (source = 'b' and tested) nb, count(*) filter (source = 'a' and tested and overturned) oa, count(*) filter (source = 'b' and tested and overturned) ob from scored group by 1)
        select count(*) strata, round(sum(ob * na / (na + nb)) / nullif(sum(oa * nb / (na + nb)), 0), 6) ratio from s where na > 0 and nb > 0""",
    "latency": f"""with {SCORED}, h as (select *, (epoch("next") - epoch(first_at)) / 3600 h from scored where tested) select source, overturned, count(*) n, round(quantile_cont(h, 0.5), 6) median_h, round(avg((h <= 24)::INT), 6) within_day from h group by 1, 2""",
    "delay_table": f"with {SCORED}, t as (select *, date_diff('day', first_at::DATE, \"next\"::DATE) d from scored where tested and overturned) select source, count(*) n, " + ", ".join(f"round(avg((d <= {h})::INT), 6) d{h}" for h in (1, 7, 30, 90, 365)) + " from t group by 1",
    "cv_error": f"""with {SCORED}, r as (select grp, source, overturned from scored where tested union all select 'all', source, overturned from scored where tested), g as (select grp, source, count(*) n, count(*) filter (overturned) wrong from r group by 1, 2),
        p as (select *, wrong / n p, {WILSON} z from g)
        select grp, source, n, wrong, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) lo,
        round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) hi, round(least(greatest((p - 0.02) / 0.96, 0), 1), 6) error from p""",
    "holm": f"""with {SCORED}, t as (select grp "name", round(avg(overturned::INT) / 10, 8) p from scored group by 1), s as (select *, (count(*) over () - row_number() over (order by p, "name") + 1) * p st from t)
        select "name", p, round(least(1, max(st) over (order by p, "name" rows between unbounded preceding and current row)), 8) adjusted from s""",
    "auc": f"with {POOL}, b as (select score, count(*) filter (status = 'F') pos, count(*) filter (status <> 'F') neg from pool where score is not null group by 1), r as (select *, sum(neg) over (order by score) - neg below from b) select round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) auc, sum(pos)::BIGINT positives from r",
}
