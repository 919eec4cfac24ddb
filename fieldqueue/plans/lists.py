"""Queries of orders, places and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldqueue.operators import ordering
from fieldqueue.plans.views import IDENTS, POOL, idents, pool
from fieldqueue.sources.tables import table

DRAW = "('0x' || substr(md5('{seed}:' || {col}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


def surprise_pool(s, d):
    p = pool(s, d)
    return p.withColumn("surprise", F.col("score")).withColumn("surprise_n", F.when(F.col("id") % 4 != 0, F.col("id") % 9))


def parts_levels(s, d):
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), F.col("p_type").alias("taxon"), F.col("p_retailprice").alias("key"))


def listed(s, d):
    p = pool(s, d).where("score is not null")
    a = p.where("id % 2 = 0").select(F.lit("a").alias("list"), "id", "score")
    b = p.where("id % 3 = 0").select(F.lit("b").alias("list"), "id", (F.col("score") / 2).alias("score"))
    w = p.where("id % 5 = 0").select(F.lit("whole").alias("list"), "id", (F.col("score") / 4).alias("score"))
    return a.unionByName(b).unionByName(w)


def first_touch(s, d):
    i = idents(s, d).where("coalesce(user_id <> observer_id, true) and user_id is not null and created_at >= timestamp'1996-01-01'")
    return i.groupBy("id").agg(F.min("created_at").alias("first_touch"))


def latest_per_user(s, d):
    i = idents(s, d).where("user_id is not null and created_at < timestamp'1997-01-01'")
    return ordering.place(i, ["id", "user_id"], [F.col("created_at").desc(), F.col("seq").asc()], "_p").where("_p = 0").select("id", "user_id", "created_at", "seq", "answer")


def running_grade(s, d):
    """When at least two identifications so far, and more than two thirds of all so far, agree with the record's last answer."""
    i = idents(s, d)
    last = i.groupBy("id").agg(F.max_by("answer", F.struct("created_at", "seq", "answer")).alias("final"))
    w = Window.partitionBy("id").orderBy("created_at", "seq", "answer").rowsBetween(Window.unboundedPreceding, 0)
    r = i.join(last, "id").withColumn("n", F.count("*").over(w)).withColumn("agree", F.count_if(F.col("answer") == F.col("final")).over(w))
    return r.where("agree >= 2 and 3 * agree > 2 * n").groupBy("id").agg(F.min("created_at").alias("reached"))


def running_step(s, d):
    e = table(s, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    second = F.datediff("ts", F.lit("1970-01-01")) * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.date_part(F.lit("SECOND"), "ts")).cast("int")
    return e.select("event_id", "user_id", (second - F.lag(second, 1, 0).over(w)).alias("delta"))


def gaps(s, d):
    p = pool(s, d)
    days = F.datediff(F.lit("1998-08-02"), "created_at")
    score = (40 * (F.col("status") == "O").cast("int") + 30 * (1 - F.least(days, F.lit(30)) / 30) + 30 * (F.col("grp").startswith("1")).cast("int")) / 100
    return p.select("id", F.round(score, 6).alias("gap")).orderBy(F.col("gap").desc(), F.col("id").desc()).limit(200)


QUERIES = {
    "order_recency": lambda s, d: ordering.ranked(pool(s, d), ["grp"], ordering.recency()).select("id", "grp", "place"),
    "order_score": lambda s, d: ordering.ranked(pool(s, d), ["grp"], ordering.by_score("score")).select("id", "grp", "place"),
    "order_surprise": lambda s, d: ordering.ranked(surprise_pool(s, d), ["grp"], ordering.by_surprise(["surprise", "surprise_n"])).select("id", "grp", "place"),
    "win_pct_rank_first": lambda s, d: ordering.top_share(pool(s, d), "grp", "score", 0.25).select("id", "picked"),
    "win_group_quantile": lambda s, d: ordering.group_quantile(parts_levels(s, d), "grp", "key", 0.9).select("id", F.round("cut", 4).alias("cut")),
    "win_cap": lambda s, d: ordering.place(parts_levels(s, d), ["taxon"], [F.col("key").desc(), F.col("id").asc()], "_p").where("_p < 3").select("id", "taxon"),
    "win_turns": lambda s, d: ordering.interleaved(parts_levels(s, d).withColumn("draw", ordering.seeded(1, "id")), "grp", "draw").select("id", "turn", F.col("_least").alias("least")),
    "win_quantize16": lambda s, d: ordering.sixteenths(parts_levels(s, d), "grp", [F.col("key").desc(), F.col("id").asc()]).select("id", "q16", "pct"),
    "win_first_lists": lambda s, d: ordering.first_lists(parts_levels(s, d), "grp", "taxon", F.col("key"), 3).select("id", "grp", "rest"),
    "win_latest_per_user": latest_per_user,
    "win_running_grade": running_grade,
    "win_first_touch": first_touch,
    "win_stepcount": running_step,
    "sample_strata": lambda s, d: ordering.sample_strata(pool(s, d), ["grp", "status"], 40, 7).select("id", "grp", "status"),
    "sample_tenth": lambda s, d: ordering.ranked(pool(s, d), ["grp"], [F.col("id").asc()]).where("place % 10 = 0").select("id"),
    "filter_user_genera": lambda s, d: ordering.share_cover(idents(s, d).where("user_id is not null"), "user_id", "answer", 0.8, 5),
    "topk_eval": lambda s, d: ordering.top_k_means(pool(s, d).withColumn("y", (F.col("status") == "F").cast("double")), "y", ordering.by_score("score"), [10, 100, 1000]),
    "list_fuse": lambda s, d: ordering.fused(listed(s, d), "whole", 50),
    "gaps_score": gaps,
}

W = "partition by grp order by"
PARTS = "parts as (select p_partkey id, p_brand grp, p_type taxon, p_retailprice \"key\" from part)"
ORACLE = {
    "order_recency": f"with {POOL} select id, grp, (row_number() over ({W} created_at desc nulls last, id desc) - 1)::INT place from pool",
    "order_score": f"with {POOL} select id, grp, (row_number() over ({W} score desc nulls last, created_at desc, id desc) - 1)::INT place from pool",
    "order_surprise": f"with {POOL} select id, grp, (row_number() over ({W} score desc nulls last, case when id % 4 <> 0 then id % 9 end asc nulls last, created_at desc, id desc) - 1)::INT place from pool",
    "win_pct_rank_first": f"with {POOL} select id, row_number() over ({W} score desc nulls last, id) / count(*) over (partition by grp) <= 0.25 picked from pool",
    "win_group_quantile": f"with {PARTS}, c as (select grp, quantile_cont(\"key\", 0.9) cut from parts group by 1) select id, round(cut, 4) cut from parts join c using (grp)",
    "win_cap": f"with {PARTS} select id, taxon from parts qualify row_number() over (partition by taxon order by \"key\" desc, id) <= 3",
    "win_turns": f"with {PARTS}, r as (select *, {DRAW.format(seed=1, col='id')} dr from parts) select id, (row_number() over (partition by grp order by dr, id) - 1)::INT turn, min(dr) over (partition by grp) least from r",
    "win_quantize16": f"with {PARTS}, r as (select *, row_number() over ({W} \"key\" desc, id) - 1 r, count(*) over (partition by grp) n from parts) select id, ((n - 1 - r) * 16 // n)::INT q16, ceil(100 * (r + 1) / n)::INT pct from r",
    "win_first_lists": f"with {PARTS}, m as (select *, min(taxon) over (partition by grp) = max(taxon) over (partition by grp) or row_number() over (partition by grp, taxon order by \"key\" desc nulls last, id desc) <= 3 keep from parts), c as (select *, count(*) filter (not keep) over (partition by grp) rest from m) select id, grp, rest from c where keep",
    "win_latest_per_user": f"with {IDENTS} select id, user_id, created_at, seq, answer from idents where user_id is not null and created_at < timestamp '1997-01-01' qualify row_number() over (partition by id, user_id order by created_at desc, seq) = 1",
    "win_running_grade": f"with {IDENTS}, l as (select id, arg_max(answer, (created_at, seq, answer)) final from idents group by 1), r as (select i.*, count(*) over w n, count(*) filter (answer = final) over w agree from idents i join l using (id) window w as (partition by id order by created_at, seq, answer rows between unbounded preceding and current row)) select id, min(created_at) reached from r where agree >= 2 and 3 * agree > 2 * n group by 1",
    "win_first_touch": f"with {IDENTS} select id, min(created_at) first_touch from idents where coalesce(user_id <> observer_id, true) and user_id is not null and created_at >= timestamp '1996-01-01' group by 1",
    "win_stepcount": "select event_id, user_id, (floor(epoch(ts)) - lag(floor(epoch(ts)), 1, 0) over (partition by user_id order by ts, event_id))::INT delta from events",
    "sample_strata": f"with {POOL}, r as (select *, {DRAW.format(seed=7, col='id')} dr from pool) select id, grp, status from r qualify row_number() over (partition by grp, status order by dr, id) <= 40",
    "sample_tenth": f"with {POOL} select id from pool qualify (row_number() over ({W} id) - 1) % 10 = 0",
    "filter_user_genera": f"with {IDENTS}, n as (select user_id, answer, count(*) n from idents where user_id is not null group by 1, 2), c as (select *, sum(n) over (partition by user_id) t, sum(n) over (partition by user_id order by n desc, answer) - n b from n) select user_id, answer, n from c where t >= 5 and b < 0.8::DOUBLE * t",
    "topk_eval": f"with {POOL}, r as (select status, row_number() over (order by score desc nulls last, created_at desc, id desc) p from pool) select " + ", ".join(f"avg((status = 'F')::INT) filter (p <= {k}) top{k}" for k in (10, 100, 1000)) + " from r",
    "list_fuse": f"""with {POOL}, p as (select id, score from pool where score is not null), l as (select 'a' list, id, score from p where id % 2 = 0 union all select 'b', id, score / 2 from p where id % 3 = 0 union all select 'whole', id, score / 4 from p where id % 5 = 0),
        fl as (select list, min(score) floor_ from l group by 1), ids as (select distinct id from l), x as (select ids.id, fl.list, coalesce(score, floor_) v, case when fl.list = 'whole' then score end w from ids cross join fl left join l on l.id = ids.id and l.list = fl.list)
        select id, min(v) fused from x group by 1 order by fused desc, max(w) desc nulls last, id limit 50""",
    "gaps_score": f"with {POOL} select id, round((40 * (status = 'O')::INT + 30 * (1 - least(date_diff('day', created_at::DATE, date '1998-08-02'), 30) / 30) + 30 * (grp like '1%')::INT) / 100, 6) gap from pool order by gap desc, id desc limit 200",
}
