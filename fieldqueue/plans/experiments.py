"""Queries of fitted temperatures, tests of hypotheses and orders against random ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldqueue.operators import hypotheses, temperature
from fieldqueue.plans.reviews import MAJ, firsts, majority, public
from fieldqueue.plans.views import IDENTS, POOL, pool
from fieldqueue.sources.tables import table


def margins(s, d):
    """Line items as margins whose sign tells the outcome the better, the larger it is."""
    li = table(s, d, "lineitem")
    m = F.round(F.col("l_discount") - F.col("l_tax"), 4)
    u = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 1000 / 1000
    return li.select(F.col("l_suppkey").alias("cluster"), m.alias("margin"), (u < 1 / (1 + F.exp(m / 0.03))).cast("int").alias("y"))


def fitted(s, d):
    f = temperature.fit(margins(s, d))
    row = (round(f.temp, 6), round(f.loss, 6), round(temperature.loss(margins(s, d), 0.02), 6), f.n)
    return s.createDataFrame([row], "temp double, loss double, loss_before double, n long")


def resolved(s, d):
    """Orders whose name later turned out to be the suggestion or the runner-up."""
    o = table(s, d, "orders")
    name = lambda k: F.concat(F.lit("genus s"), k.cast("string"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    why = o.select(k.alias("id"), F.when(k % 3 == 0, "narrow").otherwise("easy").alias("level"), name(c % 5).alias("looks_like"), F.when(k % 7 != 0, name(c % 5 + 1)).alias("runner_up"), ((k % 100) / 1000).alias("score2"))
    after = o.where(k % 2 == 0).select(k.alias("id"), name(k % 6).alias("taxon_name"), F.when(k % 5 == 0, "genus").otherwise("species").alias("rank"), c.alias("user_id"))
    left = o.where((k % 4 == 1) | (k % 10 == 0)).select(k.alias("id"), F.when(k % 11 == 0, "genus").otherwise(name(k % 6)).alias("taxon_name"), c.alias("user_id"))
    return temperature.resolved(why, after, left).select("id", "cluster", F.round("margin", 6).alias("margin"), "y")


def levels(s, d):
    return pool(s, d).select(F.col("id").alias("record"), (F.col("id") % 4).alias("level"))


def tested(s, d):
    t = hypotheses.hypotheses(majority(s, d), firsts(s, d), public(s, d), levels(s, d), ("a", "b"), 0.5)
    return t.where("test <> 'detection'").select("test", F.round("statistic", 6).alias("statistic"), "n")


def detected(s, d):
    """Detection by rank of the record's age, nowcast with weights of a year's growth; intervals are held by tests."""
    age = pool(s, d).select(F.col("id").alias("record"), "grp", F.least(F.lit(1.0), F.datediff(F.lit("1999-01-01"), "created_at") / 730).alias("complete"))
    j = hypotheses.scored(majority(s, d), firsts(s, d), public(s, d), 0.5).join(age, "record")
    out = hypotheses.detection(j, "grp", reps=200, c=0.02, c_n=100, nowcast=True)
    return out.select("grp", "source", "n", *[F.round(c, 6).alias(c) for c in ("error", "overturned", "detected")])


def bands(s, d):
    p = pool(s, d).select("id", "created_at", "score", (F.col("status") == "F").cast("int").alias("done"), (F.col("status") == "P").cast("int").alias("stuck"))
    orders = {"newest": [F.col("created_at").desc(), F.col("id").asc()], "score": [F.col("score").desc_nulls_last(), F.col("id").asc()]}
    c = hypotheses.compared(p, orders, ["done", "stuck"], [10, 100, 400], reps=40, seed=5)
    return c.select("order", "k", "outcome", *[F.round(x, 9).alias(x) for x in ("share", "low", "high")])


QUERIES = {"fit_temp": fitted, "fit_temp_rows": resolved, "hypothesis": tested, "detection_nowcast": detected, "topk_compare": bands}
SCORED = f"""{IDENTS}, {MAJ}, sc as (select record, source, ("label" <> "first")::INT wrong, (public <> "first")::INT "over" from maj join fst using (record) join pub using (record) where posterior >= 0.5)"""
ORACLE = {
    "fit_temp": """with recursive m as materialized (select round(l_discount - l_tax, 4) m, ((l_orderkey * 7919 + l_linenumber * 104729) % 1000 / 1000 < 1 / (1 + exp(round(l_discount - l_tax, 4) / 0.03)))::INT y from lineitem),
        c as materialized (select m::DOUBLE m, y, count(*) k from m group by 1, 2),
        nb as (select 0 i, 10.0::DOUBLE b union all select i + 1, b - sum(k * m * (1 / (1 + exp(-m * b)) - 1 + y)) / sum(k * m * m / (1 + exp(-m * b)) / (1 + exp(m * b))) from nb, c where i < 30 group by i, b),
        f as (select b from nb where i = 30)
        select round(1 / b, 6) temp, round(sum(k * ln(1 + exp(case when y = 1 then m else -m end * b))) / sum(k), 6) loss, round(sum(k * ln(1 + exp(case when y = 1 then m else -m end * 50))) / sum(k), 6) loss_before, sum(k)::BIGINT n from c, f group by b""",
    "fit_temp_rows": """with o as (select o_orderkey k, o_custkey c from orders), l as (select k, c, 'genus s' || (k % 6) nm from o where k % 2 = 0 and k % 5 <> 0
        union all select k, c, 'genus s' || (k % 6) from o where (k % 4 = 1 or k % 10 = 0) and k % 11 <> 0 and not (k % 2 = 0 and k % 5 <> 0))
        select k id, c "cluster", round((k % 100) / 1000, 6) margin, (nm = 'genus s' || (c % 5 + 1))::INT y from l where k % 3 = 0 and k % 7 <> 0 and nm in ('genus s' || (c % 5), 'genus s' || (c % 5 + 1))""",
    "hypothesis": f"""with {SCORED}, e as (select maj.record, source, ("label" <> "first")::INT wrong from maj join fst using (record) where posterior >= 0.5),
        lv as (select record % 4 lv, (posterior >= 0.5)::INT st from maj where record in (select o_orderkey from orders)), rk as (select lv, st, rank() over (order by lv) + (count(*) over (partition by lv) - 1) / 2 a, rank() over (order by st) + (count(*) over (partition by st) - 1) / 2 b from lv)
        select 'error' test, round(avg(wrong) filter (source = 'a') - avg(wrong) filter (source = 'b'), 6) statistic, count(*) n from e union all select 'levels', round(corr(a, b), 6), count(*) from rk having corr(a, b) is not null""",
    "detection_nowcast": f"""with {SCORED}, {POOL}, j as (select sc.*, grp, least(1.0, date_diff('day', created_at::DATE, date '1999-01-01') / 730) complete from sc join pool on id = record), a as (select * from j union all select record, source, wrong, "over", 'all', complete from j),
        g as (select grp, source, count(*) n, least(greatest((avg(wrong) - 0.02) / 0.96, 0), 1) error, sum("over") / sum(complete) overturned from a group by 1, 2)
        select grp, source, n, round(error, 6) error, round(overturned, 6) overturned, round(case when error > 0 then overturned / error end, 6) detected from g""",
    "topk_compare": f"""with {POOL}, q as (select id, created_at, score, (status = 'F')::INT done, (status = 'P')::INT stuck from pool), ks as (select unnest([10, 100, 400]) k),
        dr as (select rep, done, stuck, row_number() over (partition by rep order by ('0x' || substr(md5('5:' || rep || ':' || id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE, id) place from q, range(1, 41) t(rep)),
        rs as (select rep, k, avg(done) done, avg(stuck) stuck from dr, ks where place <= k group by 1, 2), un as (select k, 'done' outcome, done v from rs union all select k, 'stuck', stuck from rs),
        bd as (select k, outcome, quantile_cont(v, 0.025) low, quantile_cont(v, 0.975) high from un group by 1, 2),
        od as (select 'newest' "order", done, stuck, row_number() over (order by created_at desc, id) place from q union all select 'score', done, stuck, row_number() over (order by score desc nulls last, id) from q),
        os as (select "order", k, avg(done) done, avg(stuck) stuck from od, ks where place <= k group by 1, 2), ou as (select "order", k, 'done' outcome, done share from os union all select "order", k, 'stuck', stuck from os)
        select "order", k, outcome, round(share, 9) share, round(low, 9) low, round(high, 9) high from ou join bd using (k, outcome)""",
}
