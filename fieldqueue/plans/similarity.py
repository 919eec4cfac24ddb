"""Queries of vectors, levels, neighbours and consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldqueue.operators import analysis, consensus, vectors
from fieldqueue.plans.counting import pairs
from fieldqueue.plans.batching import ARMS
from fieldqueue.plans.views import IDENTS, PAIRS, SERVED, served
from fieldqueue.sources.tables import table


def rows(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), F.col("embedding").alias("v"))


def scores(s, d):
    p = vectors.prototype_scores(rows(s, d))
    return p.withColumn("margin", F.col("own") - F.col("other")).withColumn("top", F.greatest("own", "other")).withColumn("grp", F.col("label") % 3)


def leveled(s, d):
    """Levels of the embeddings: two of seven stand above species, their own class as the likely species of the clade."""
    genus = F.col("id") % 7 < 2
    x = scores(s, d).withColumn("rank", F.when(genus, "genus").otherwise("species"))
    only = lambda c: F.when(genus, c)
    x = x.withColumns({"in_best": only(F.col("own")), "in_second": only(F.col("own") - (F.col("id") % 5) / 50), "out_best": only(F.col("other")), "in_label": only(F.col("label")), "second_label": only((F.col("label") + 1) % 10)})
    return rounded(vectors.levels(x), "score", "score2")


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def neighbours(s, d):
    return vectors.exact_neighbours(rows(s, d).where("id % 10 = 0"), rows(s, d), 5)


def agreement(s, d):
    lab = rows(s, d).select("id", "label")
    n = neighbours(s, d).join(lab, "id").join(lab.withColumnsRenamed({"id": "nb", "label": "nl"}), "nb")
    return n.groupBy("id").agg(F.floor(F.avg((F.col("label") == F.col("nl")).cast("double")) * 12 + 0.5).cast("int").alias("twelfths"))


def layout(s, d):
    known = rows(s, d).where("id % 10 <> 0").select("id", (F.col("id") % 97 / 97).alias("x"), (F.col("id") % 89 / 89).alias("y"))
    return rounded(vectors.placed(neighbours(s, d).select("id", "nb", "cos"), known), "x", "y")


def confused(s, d):
    return scores(s, d).where("margin < 0").groupBy("label", "other_label").agg(F.count("*").alias("n"))


def answers(s, d):
    li = table(s, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("login"), F.col("l_orderkey").alias("record"), F.col("l_returnflag").alias("label"))


QUERIES = {
    "proto_loo": lambda s, d: rounded(scores(s, d).select("id", "own", "other", "other_label"), "own", "other"),
    "levels_assign": leveled,
    "confused_pairs": confused,
    "batch_signals": lambda s, d: rounded(vectors.cohesion(rows(s, d).withColumn("batch", F.floor(F.col("id") / 50)), "batch"), "cohesion"),
    "unit": lambda s, d: rows(s, d).select("id", F.round(F.array_max(vectors.unit("v")), 6).alias("largest")),
    "topk_cosine": lambda s, d: neighbours(s, d).select("id", "place", "nb"),
    "nn_agreement": agreement,
    "layout_place": layout,
    "dawid_skene": lambda s, d: consensus.consensus(answers(s, d)).withColumn("posterior", F.round("posterior", 4)),
}

BASE = "r as (select vec_id id, \"label\", embedding::DOUBLE[] v from embeddings)"
NB = f"{BASE}, x as (select a.id, b.id nb, list_cosine_similarity(a.v, b.v) c from r a, r b where a.id % 10 = 0 and a.id <> b.id), nbs as (select *, row_number() over (partition by id order by round(c, 12) desc, nb) place from x qualify place <= 5)"
PROTO = f"""{BASE}, u as (select id, "label", list_transform(v, lambda y: y / sqrt(list_dot_product(v, v))) u from r), e as (select id, "label", unnest(u) x, unnest(range(0, len(u))) i from u),
t as (select "label", i, sum(x) s, count(*) n from e group by 1, 2), m as (select "label", list(s order by i) total, max(n) n from t group by 1 having max(n) >= 4),
o as (select id, u."label", u, [a - b for a, b in zip_(total, u)] rest from u left join m using ("label"))"""
PROTO = PROTO.replace("[a - b for a, b in zip_(total, u)]", "list_transform(list_zip(total, u), lambda z: z[1] - z[2])")
SCORES = PROTO + """, w as (select o.id, o."label", m."label" ol, list_cosine_similarity(u, total) c from o, m where m."label" <> o."label"), b as (select id, max(c) other, arg_max(ol, (c, -ol)) other_label from w group by 1),
s as (select id, o."label", list_cosine_similarity(u, rest) own, other, other_label from o join b using (id)), sc as (select *, own - other margin, greatest(own, other) top, "label" % 3 grp from s)"""


def skene_sql(rounds: int) -> str:
    """The rounds of consensus() one after another, each a materialised step."""
    steps = ["""a as materialized (select l_suppkey login, l_orderkey record, l_returnflag "label", count(*) k from lineitem group by 1, 2, 3)""", "n as (select greatest(1, count(distinct \"label\") - 1) wrong from a)", "p as materialized (select a.*, g.guess from a join (select distinct record, \"label\" guess from a) g using (record))", "tot as materialized (select login, sum(k) n from a group by 1)", "s0 as materialized (select login, 0.8::DOUBLE acc from tot)"]
    for i in range(rounds + 1):
        steps.append(f"l{i} as materialized (select record, guess, sum(k * case when \"label\" = guess then ln(acc) else ln((1 - acc) / (select wrong from n)) end) l from p join s{i} using (login) group by 1, 2)")
        steps.append(f"q{i} as materialized (select record, guess, exp(l - max(l) over (partition by record)) / sum(exp(l)) over (partition by record) * exp(max(l) over (partition by record)) v from l{i})")
        if i < rounds:
            steps.append(f"s{i + 1} as materialized (select tot.login, (coalesce(r, 0) + 1) / (n + 2) acc from tot left join (select login, sum(k * v) r from p join q{i} using (record, guess) where \"label\" = guess group by 1) using (login))")
    return "with " + ", ".join(steps) + f" select record, max((round(v, 9), guess))[2] \"label\", round(max((round(v, 9), guess))[1], 4) posterior from q{rounds} group by 1"


ORACLE = {
    "proto_loo": f"with {SCORES} select id, round(own, 6) own, round(other, 6) other, other_label from sc",
    "levels_assign": f"""with {SCORES}, x as (select *, case when id % 7 < 2 then 'genus' else 'species' end rank from sc), sp as (select * from x where rank = 'species' and own is not null and other is not null),
        lw as (select grp, quantile_cont(top, 0.02) lo from x group by 1), ct as (select grp, quantile_cont(margin, 0.75) cut from sp where margin < 0 group by 1), nn as (select "label", count(*) n from sp group by 1),
        bs as (select id, row_number() over (partition by "label" order by own desc, id) / count(*) over (partition by "label") <= 0.25 picked from sp),
        j as (select x.*, lo, cut, picked, nn.n, coalesce(k.n >= 20, false) known from x left join lw using (grp) left join ct using (grp) left join bs using (id) left join nn using ("label") left join nn k on k."label" = x.other_label),
        l as (select *, case when top <= lo then 'weird' when picked is not null and margin > 0 and n >= 4 and picked then 'easy' when picked is not null and margin < 0 and margin >= cut and known then 'taxonomist' when rank <> 'species' and own is not null then 'narrow' when picked is not null and margin < cut and known then 'mislabel' else 'none' end "level" from j)
        select id, "level", round(case "level" when 'weird' then top when 'easy' then own when 'taxonomist' then margin when 'mislabel' then margin when 'narrow' then least(own - other, (id % 5) / 50) end, 6) score, round(case when "level" = 'narrow' then (id % 5) / 50 end, 6) score2,
        case when "level" in ('taxonomist', 'mislabel') then other_label when "level" = 'narrow' then "label" end::INT looks_like, case when "level" = 'narrow' then ("label" + 1) % 10 end::INT runner_up from l""",
    "confused_pairs": f"with {SCORES} select \"label\", other_label, count(*) n from sc where margin < 0 group by 1, 2",
    "batch_signals": f"with {BASE}, u as (select id // 50 batch, list_transform(v, lambda y: y / sqrt(list_dot_product(v, v))) u from r), e as (select batch, unnest(u) x, unnest(range(0, len(u))) i from u), t as (select batch, i, sum(x) s, count(*) n from e group by 1, 2) select batch, max(n) n, round(sqrt(sum(s * s)) / max(n), 6) cohesion from t group by 1",
    "dawid_skene": skene_sql(10),
    "unit": f"with {BASE} select id, round(list_max(list_transform(v, lambda y: y / sqrt(list_dot_product(v, v)))), 6) largest from r",
    "topk_cosine": f"with {NB} select id, place::INT place, nb from nbs",
    "nn_agreement": f"with {NB} select nbs.id, floor(avg((a.\"label\" = b.\"label\")::INT) * 12 + 0.5)::INT twelfths from nbs join r a on a.id = nbs.id join r b on b.id = nbs.nb group by 1",
    "layout_place": f"with {NB} select id, round(coalesce(sum(greatest(c, 0) * (nb % 97 / 97.0::DOUBLE)) / nullif(sum(greatest(c, 0)), 0), avg(nb % 97 / 97.0::DOUBLE)), 6) x, round(coalesce(sum(greatest(c, 0) * (nb % 89 / 89.0::DOUBLE)) / nullif(sum(greatest(c, 0)), 0), avg(nb % 89 / 89.0::DOUBLE)), 6) y from nbs where nb % 10 <> 0 group by 1",
}
