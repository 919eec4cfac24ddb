"""Queries of scalars, tables, priors and intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldqueue.functions import scalars
from fieldqueue.operators import ordering, tables
from fieldqueue.operators.vectors import exact_neighbours
from fieldqueue.plans.counting import SCORED, scored
from fieldqueue.plans.similarity import NB, SCORES, rows, scores
from fieldqueue.plans.views import IDENTS, POOL, SERVED, idents, pool, served
from fieldqueue.sources.tables import table


def parts(s, d):
    return table(s, d, "part")


def points(s, d):
    """Customers in a plane, keyed by nation."""
    c = table(s, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("key"), (F.col("c_custkey") * 7919 % 1000 / 10).alias("x"), (F.col("c_custkey") * 104729 % 1000 / 10).alias("y"))


def ecdf(s, d):
    days = scored(s, d).where("tested and overturned").select(F.datediff("next", "first_at").cast("double").alias("delay"))
    return tables.step_function(pool(s, d).select((F.col("id") % 400).cast("double").alias("age")), days).select("age", F.round("share", 6).alias("share"))


def delta_scores(s, d):
    """Scores of a base version where the record's name still agrees, else scored anew."""
    p = pool(s, d)
    base = p.where("id % 4 <> 0").select("id", F.when(F.col("id") % 9 == 0, "other").otherwise(F.col("grp")).alias("grp"), F.lit("base").alias("origin"))
    valid = base.join(p.select("id", "grp"), ["id", "grp"])
    fresh = p.join(valid.select("id"), "id", "left_anti").select("id", "grp", F.lit("new").alias("origin"))
    return valid.unionByName(fresh)


def suggestions(s, d):
    n = parts(s, d).groupBy("p_type").agg(F.count("*").alias("n"))
    return n.where(F.contains(F.lower("p_type"), F.lit("st"))).orderBy(F.col("n").desc(), "p_type").limit(10)


def contrasts(s, d):
    """Rates of two states by group, beside those of the urgent ones."""
    p = pool(s, d).withColumns({"done": (F.col("status") == "F").cast("int"), "stuck": (F.col("status") == "P").cast("int")})
    c = tables.level_contrasts(p, "user_id", "grp", ["done", "stuck"], "1-URGENT", 200, 5)
    return c.select("grp", "outcome", *[F.round(v, 6).alias(v) for v in c.columns[2:]])


QUERIES = {
    "cell_blend": lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("a"), F.col("l_tax").alias("b")).select("l_orderkey", "l_linenumber", F.round(scalars.clipped_blend({"a": 10.0, "b": 6.0}), 6).alias("score")),
    "range_note": lambda s, d: pool(s, d).select("id", scalars.range_note(F.when(F.col("id") % 3 > 0, F.col("id") % 3 == 1), F.when(F.col("id") % 5 > 1, F.col("id") % 5 > 2)).alias("note")),
    "name_fold": lambda s, d: parts(s, d).select("p_partkey", scalars.plain_name(F.concat("p_type", F.lit(" / "), "p_brand")).alias("name")),
    "genus": lambda s, d: parts(s, d).select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("genus"), (F.size(F.split("p_type", r"\s+")) == 2).alias("two_words")),
    "suggest": suggestions,
    "sha_rows": lambda s, d: pool(s, d).select("id", F.substring(F.sha2(F.concat(F.lit("record:"), F.col("id").cast("string")), 256), 1, 12).alias("fingerprint")),
    "tier": lambda s, d: idents(s, d).groupBy("id").agg(F.collect_set("answer").alias("a")).select("id", scalars.tier(F.transform("a", lambda x: F.when(x == "R", "EN").when(x == "A", "VU").otherwise("LC"))).alias("tier")),
    "completeness": ecdf,
    "fir_table": lambda s, d: tables.confusion_table(scores(s, d), 2, 4, 3).select("label", "other", "n", F.round("share", 6).alias("share")),
    "margin_hist": lambda s, d: tables.histogram(scores(s, d), "grp", "margin", -0.5, 0.5, 20),
    "topk_pairs": lambda s, d: ordering.place(scores(s, d), ["label", "other_label"], [F.col("margin").asc(), F.col("id").asc()]).where("place < 3").select("id", "label", "other_label"),
    "win_known": lambda s, d: scores(s, d).select("id", (F.count("*").over(Window.partitionBy("other_label")) >= 20).alias("known")),
    "level_stats": lambda s, d: tables.cluster_bootstrap(pool(s, d).withColumn("y", (F.col("status") == "F").cast("int")), "user_id", "grp", "y", 1000, 3).select("grp", *[F.round(c, 6).alias(c) for c in ("rate", "low", "high")]),
    "level_contrasts": contrasts,
    "scores_delta": delta_scores,
    "merge_arm": lambda s, d: pool(s, d).where("id % 3 = 0").join(served(s, d).select("id", "arm"), "id", "left").select("id", F.when(F.col("arm").isNull(), F.raise_error(F.lit("a record has no arm")).cast("string")).otherwise(F.col("arm")).alias("arm")),
    "src_totals": lambda s, d: pool(s, d).groupBy("grp", "status", F.trunc("created_at", "MM").alias("month")).agg(F.count("*").alias("n")),
    "nn_lookup": lambda s, d: exact_neighbours(rows(s, d), rows(s, d), 1).select("id", "nb"),
}
DELTA = "p as (select * from pool), base as (select id, case when id % 9 = 0 then 'other' else grp end grp from pool where id % 4 <> 0), valid as (select id, grp from base semi join pool using (id, grp))"
ORACLE = {
    "cell_blend": "select l_orderkey, l_linenumber, round(least(greatest(l_discount * 10 + l_tax * 6, 0), 1), 6) score from lineitem",
    "range_note": "with a as (select o_orderkey id, case when o_orderkey % 3 > 0 then o_orderkey % 3 = 1 end l, case when o_orderkey % 5 > 1 then o_orderkey % 5 > 2 end r from orders) select id, case when l is null or r is null then null when not l and not r then 'both out' when l and not r then 'label' when not l and r then 'other' end note from a",
    "name_fold": "select p_partkey, trim(regexp_replace(lower(p_type || ' / ' || p_brand), '[^a-z0-9]+', ' ', 'g')) \"name\" from part",
    "genus": "select p_partkey, split_part(p_type, ' ', 1) genus, len(string_split(p_type, ' ')) = 2 two_words from part",
    "suggest": "select p_type, count(*) n from part where contains(lower(p_type), 'st') group by 1 order by n desc, p_type limit 10",
    "sha_rows": "select o_orderkey id, substr(sha256('record:' || o_orderkey), 1, 12) fingerprint from orders",
    "tier": f"with {IDENTS} select id, case when bool_or(answer = 'R') then 1 when bool_or(answer = 'A') then 2 end tier from idents group by 1",
    "completeness": f"with {SCORED}, dl as (select date_diff('day', first_at::DATE, \"next\"::DATE) x from scored where tested and overturned), ag as (select distinct (id % 400)::DOUBLE age from pool) select age, round((select count(*) from dl where x <= age) / (select count(*) from dl), 6) share from ag",
    "fir_table": f"with {SCORES}, lr as (select \"label\", count(*) k from sc group by 1 having count(*) >= 4), wr as (select \"label\", other_label other, count(*) n from sc where margin < 0 group by 1, 2 having count(*) >= 2) select \"label\", other, n, round(n / k, 6) share from wr join lr using (\"label\") qualify row_number() over (partition by \"label\" order by n desc, other) <= 3",
    "margin_hist": f"with {SCORES} select grp, least(greatest(floor((margin + 0.5) / 0.05), 0), 19)::INT bin, count(*) n from sc where margin is not null group by 1, 2",
    "topk_pairs": f"with {SCORES} select id, \"label\", other_label from sc qualify row_number() over (partition by \"label\", other_label order by margin, id) <= 3",
    "win_known": f"with {SCORES} select id, count(*) over (partition by other_label) >= 20 known from sc",
    "level_stats": f"""with {POOL}, c as (select user_id, grp, count(*) filter (status = 'F') k, count(*) n from pool group by 1, 2), u as (select c.*, rep, ('0x' || substr(md5('3:' || rep || ':' || user_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE u from c, range(1, 1001) t(rep)),
        w as (select *, case when u < 0.367879441 then 0 when u < 0.735758882 then 1 when u < 0.919698603 then 2 when u < 0.981011843 then 3 when u < 0.996340153 then 4 when u < 0.999405815 then 5 else 6 end w from u), r as (select grp, rep, sum(w * k) / sum(w * n) r from w group by 1, 2), a as (select grp, sum(k) / sum(n) rate from c group by 1)
        select grp, round(rate, 6) rate, round(quantile_cont(r, 0.025), 6) low, round(quantile_cont(r, 0.975), 6) high from r join a using (grp) group by grp, rate""",
    "level_contrasts": f"""with {POOL}, c as (select user_id, grp, count(*) n, count(*) filter (status = 'F') kd, count(*) filter (status = 'P') ks from pool group by 1, 2), u as (select c.*, rep, ('0x' || substr(md5('5:' || rep || ':' || user_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE u from c, range(0, 201) t(rep)),
        w as (select *, case when rep = 0 then 1 when u < 0.367879441 then 0 when u < 0.735758882 then 1 when u < 0.919698603 then 2 when u < 0.981011843 then 3 when u < 0.996340153 then 4 when u < 0.999405815 then 5 else 6 end w from u),
        g as (select grp, rep, sum(w * kd) / sum(w * n) d, sum(w * ks) / sum(w * n) s from w group by 1, 2), l as (select grp, rep, 'done' outcome, d rate from g union all select grp, rep, 'stuck', s from g),
        j as (select l.*, l.rate - b.rate difference, l.rate / nullif(b.rate, 0) ratio from l left join (select rep, outcome, rate from l where grp = '1-URGENT') b using (rep, outcome))
        select grp, outcome, round(max(rate) filter (rep = 0), 6) rate, round(quantile_cont(rate, 0.025) filter (rep > 0), 6) rate_low, round(quantile_cont(rate, 0.975) filter (rep > 0), 6) rate_high,
               round(max(difference) filter (rep = 0), 6) difference, round(quantile_cont(difference, 0.025) filter (rep > 0), 6) difference_low, round(quantile_cont(difference, 0.975) filter (rep > 0), 6) difference_high,
               round(max(ratio) filter (rep = 0), 6) ratio, round(quantile_cont(ratio, 0.025) filter (rep > 0), 6) ratio_low, round(quantile_cont(ratio, 0.975) filter (rep > 0), 6) ratio_high from j group by 1, 2""",
    "scores_delta": f"with {POOL}, {DELTA} select id, grp, 'base' origin from valid union all select id, grp, 'new' from pool where id not in (select id from valid)",
    "merge_arm": f"with {SERVED} select id, arm from served",
    "src_totals": f"with {POOL} select grp, status, date_trunc('month', created_at)::DATE \"month\", count(*) n from pool group by 1, 2, 3",
    "nn_lookup": f"with {NB.replace('a.id % 10 = 0 and ', '')} select id, nb from nbs where place = 1",
}
