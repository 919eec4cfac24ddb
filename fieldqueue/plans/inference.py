"""Queries of the tests of the experiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldqueue.operators import analysis, inference
from fieldqueue.plans.batching import ARMS
from fieldqueue.plans.counting import COLS, pairs
from fieldqueue.plans.views import IDENTS, PAIRS, POOL, SERVED, pool, served
from fieldqueue.sources.shared import kept

REPS, SEED = 10_000, 5
PRIMARY = {"recency": "weighted", "novelty": "plain"}


def arm_of(s, d):
    return served(s, d).select("id", "arm")


def counts(s, d):
    return analysis.by_arm(pairs(s, d), arm_of(s, d), ARMS)


def totals(s, d):
    return analysis.record_totals(pairs(s, d), arm_of(s, d))


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 8) for n in names})


def analysed(s, d):
    return rounded(inference.analyse(counts(s, d), ARMS, "control", REPS, SEED), "mean_diff", "p", "p_sign", "p_holm")


def signs(s, d):
    x = inference.differences(counts(s, d), ARMS, "control").groupBy("arm").agg(F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
    return rounded(x.withColumn("p", inference.sign_test(F.col("up"), F.col("down"))), "p")


def flips(s, d):
    x = inference.differences(counts(s, d), ARMS, "control").where("arm = 'novelty'")
    return inference.sign_flip(x, ["arm"], REPS, SEED).select("total", F.round("p", 8).alias("p"))


def shuffled(s, d):
    return rounded(inference.record_shuffle(totals(s, d), "novelty", "control", REPS, 11), "p")


def shuffled_in_strata(s, d):
    t = totals(s, d).join(pool(s, d).select("id", "grp"), "id")
    return inference.record_shuffle(t, "novelty", "control", REPS, 11, greater=True, strata="grp")


def confirmed(s, d):
    weight, both = kept(served(s, d).select("id", "arm", "score")), kept(pairs(s, d))
    arm = weight.select("id", "arm")
    n = kept(analysis.record_totals(both, arm))
    heavy = analysis.by_arm(both, weight, ARMS, "score")
    heavy_totals = n.join(weight.select("id", "score"), "id").select("id", "arm", (F.col("n") * F.coalesce("score", F.lit(0.0))).alias("n"))
    outcomes = {"plain": (analysis.by_arm(both, arm, ARMS), n), "weighted": (heavy, heavy_totals)}
    return inference.confirmatory(outcomes, ARMS, "control", PRIMARY, list(PRIMARY), 1000, SEED)


QUERIES = {
    "analyse": analysed,
    "sign_test": signs,
    "sign_flip": flips,
    "record_shuffle": shuffled,
    "record_shuffle_strata": shuffled_in_strata,
    "ratio_ci": lambda s, d: inference.ratio_interval(counts(s, d), ARMS, "control", REPS, SEED),
    "confirmatory": confirmed,
}

C = f"{IDENTS}, {SERVED}, {PAIRS}, c as (select user_id, {COLS} from pairs join served using (id) group by 1)"
D = C + ", d as (select arm, x::DOUBLE x, c::DOUBLE c, (x - c)::DOUBLE d from (select 'novelty' arm, novelty x, control c from c union all select 'recency', recency, control from c))"


def flip_sql(source: str, seed: int) -> str:
    """CTEs from rows (arm, d): tt (arm, total, n), and pv (arm, total, p) by all signs of up to twelve differences, and by random signs of more."""
    return f"""tt as (select arm, sum(d) total, count(*) filter (d <> 0) n from {source} group by 1),
    sz as (select arm, abs(d) v, count(*) m from {source} where d <> 0 group by 1, 2),
    wd as (select *, unnest(range(0, (m - 1) // 60 + 1)) word from sz),
    cn as (select arm, rep, v, least(60, m - 60 * word) k, bit_count(('0x' || substr(md5('{seed}:' || rep || ':' || round(v * 1e9)::BIGINT || ':' || word), 1, 15))::BIGINT & ((1::BIGINT << least(60, m - 60 * word)::INT) - 1)) ones from wd, range(1, {REPS} + 1) r(rep)),
    sm as (select arm, rep, sum(v * (2 * ones - k)) s from cn group by 1, 2),
    fw as (select arm, list(abs(d)) v from {source} where d <> 0 group by 1 having count(*) <= 12), fc as (select arm, v, unnest(range(0, 1 << len(v)::INT)) code from fw),
    fs as (select arm, total, list_sum(list_transform(range(1, len(v) + 1), lambda i: case when (code >> (i - 1)) & 1 = 1 then v[i] else -v[i] end)) s from fc join tt using (arm)),
    pv as (select arm, total, (count(*) filter (abs(s) >= abs(total) - 1e-9) + 1) / {float(REPS + 1)}::DOUBLE p from sm join tt using (arm) where n > 12 group by 1, 2
        union all select arm, total, avg((abs(s) >= abs(total) - 1e-9)::INT) from fs group by 1, 2 union all select arm, total, 1 from tt where n = 0)"""


SIGN = "case when up + down = 0 then 1 else least(1, 2 * list_sum(list_transform(range(0, least(up, down) + 1), lambda i: exp(lgamma(up + down + 1) - lgamma(i + 1) - lgamma(up + down - i + 1) - (up + down) * ln(2))))) end"
ORACLE = {
    "sign_test": f"with {D}, s as (select arm, count(*) filter (d > 0) up, count(*) filter (d < 0) down from d group by 1) select arm, up, down, round({SIGN}, 8) p from s",
    "sign_flip": f"with {D}, nv as (select * from d where arm = 'novelty'), {flip_sql('nv', SEED)} select total, round(p, 8) p from pv",
    "record_shuffle": f"with {IDENTS}, {SERVED}, {PAIRS}, n as (select id, count(*) n from pairs group by 1), t as (select 'x' arm, (case when arm = 'novelty' then 1 else -1 end * coalesce(n, 0))::DOUBLE d from served left join n using (id) where arm in ('novelty', 'control')), {flip_sql('t', 11)} select total, round(p, 8) p from pv",
    "analyse": f"""with {D}, {flip_sql('d', SEED)}, s as (select arm, count(*) n_identifiers, sum(x) total, sum(c) total_control, avg(d) mean_diff, count(*) filter (d > 0) up, count(*) filter (d < 0) down from d group by 1),
        j as (select s.*, p, (count(*) over () - row_number() over (order by p, arm) + 1) * p step from s join pv using (arm))
        select arm, 'control' control, n_identifiers, total, total_control, round(mean_diff, 8) mean_diff, round(p, 8) p, round({SIGN}, 8) p_sign, round(least(1, max(step) over (order by p, arm rows between unbounded preceding and current row)), 8) p_holm from j""",
}
