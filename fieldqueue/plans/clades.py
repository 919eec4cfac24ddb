"""Queries of clades, levels in the order to show, planted records, rings and held-out consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldqueue.operators import consensus, geo, state, vectors
from fieldqueue.plans.similarity import BASE, NB, SCORES, answers, neighbours, rows, scores
from fieldqueue.plans.views import IDENTS, POOL, idents, pool
from fieldqueue.sources.tables import table


def clade(s, d):
    """Records above species against the ten classes as species, whose places are their numbers, and clades of three of them."""
    r, node = rows(s, d).where("id % 7 < 2"), F.col("id") % 4
    classes = vectors.sums(rows(s, d).withColumn("u", vectors.unit("v")), "label", "u").select("label", F.col("label").cast("long").alias("at"), "total")
    out = vectors.clade_scores(r.select("id", "v", (node * 3).alias("lo"), F.least(node * 3 + 2, F.lit(9)).alias("hi")), classes)
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("in_best", "in_second", "out_best")], "in_label", "second_label")


def shown(s, d):
    x = scores(s, d).where("own is not null")
    level = F.when(F.col("margin") < 0, "weird").when(F.col("margin") < 0.05, "taxonomist").otherwise("easy")
    return vectors.levels_three(x.select("id", level.alias("level"), "label", "grp", F.round("top", 9).alias("score")), 20, 3, 13)


def planted(s, d):
    """Settled records that two or more others agree on, by the source of the first own name and whether it held."""
    i = idents(s, d)
    rg = pool(s, d).where("status = 'F'").select("id", "grp").join(i.groupBy("id").agg(F.max("answer").alias("taxon")), "id")
    agree = i.where("coalesce(user_id <> observer_id, false)").join(rg, "id").where("answer = taxon").groupBy("id").agg(F.count_distinct("user_id").alias("n")).where("n >= 2")
    first = i.groupBy("id").agg(F.min(F.struct("created_at", "seq", "answer")).alias("f")).select("id", F.col("f.answer").alias("first"))
    kind = F.concat(F.when(F.col("id") % 2 == 0, "cv").otherwise("typed"), F.when(F.col("first") == F.col("taxon"), "_hold").otherwise("_fail"))
    return rg.join(agree, "id").join(first, "id").select("id", "grp", "taxon", kind.alias("kind"))


def first_candidate(s, d):
    """The label of each record's first neighbour of another label; null where there is none."""
    lab = rows(s, d).select("id", "label")
    n = neighbours(s, d).join(lab, "id").join(lab.withColumnsRenamed({"id": "nb", "label": "other"}), "nb").where("other <> label")
    best = n.groupBy("id").agg(F.min_by("other", "place").alias("other"))
    return lab.where("id % 10 = 0").select("id").join(best, "id", "left")


def ringed(s, d):
    """Customers in the first of the suppliers' triangles that holds them."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 1000).cast("double").alias("x"), (F.col("c_custkey") * 91 % 1000).cast("double").alias("y"))
    x, y = F.col("s_suppkey") * 53 % 950, F.col("s_suppkey") * 71 % 950
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    u = table(s, d, "supplier").select(F.col("s_suppkey").alias("cell"), F.array(point(x, y), point(x + 47.5, y), point(x + 12.5, y + 49.5)).alias("ring"))
    return geo.in_rings(c, u, 100.0).select("id", "cell")


def lists_of_parts(s, d):
    """Neighbour lists of two parts, of which the later counts, for the ids that are kept."""
    n = neighbours(s, d).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "nb"))), lambda r: r["nb"].cast("string")), ",").alias("nb"))
    both = n.withColumn("part", F.lit("a")).unionByName(n.where("id % 30 = 0").select("id", F.lit("none").alias("nb"), F.lit("b").alias("part")))
    return state.compact(both, rows(s, d).where("id % 50 <> 0")).select("id", "nb")


def layout(s, d):
    xy = rows(s, d).select("id", (F.col("id") * 31 % 1000).alias("x"), (F.col("id") * 17 % 1000).alias("y"))
    both = xy.where("id % 4 <> 0").withColumn("part", F.lit("a")).unionByName(xy.where("id % 3 = 0").withColumn("x", F.col("x") + 1000).withColumn("part", F.lit("b")))
    return state.compact(both, rows(s, d).where("id % 7 <> 0")).select("id", "x", "y")


def held(s, d):
    a = answers(s, d)
    known = a.where("record % 20 = 0").groupBy("record").agg(F.max("label").alias("label"))
    return consensus.held_out(a, known, 0.9).groupBy("truth").agg(F.count("*").alias("n"), F.sum("wrong").alias("wrong"))


SPAN = "clades as (select t.node, t.node * 3 lo, least(t.node * 3 + 2, 9) hi from range(4) t(node))"
MEANS = f"{BASE}, u as (select id, \"label\", list_transform(v, lambda y: y / sqrt(list_dot_product(v, v))) u from r), e as (select \"label\", unnest(u) x, unnest(range(0, len(u))) i from u), t as (select \"label\", i, sum(x) s from e group by 1, 2), m as (select \"label\" at_, list(s order by i) m from t group by 1)"
ENTRIES = {
    "clade_scores": (clade, f"""with {MEANS}, {SPAN}, w as (select u.id, id % 4 node, at_, round(list_cosine_similarity(u, m), 9) c from u, m where id % 7 < 2), x as (select w.*, at_ between lo and hi inside from w join clades using (node)),
        k as (select *, row_number() over (partition by id, inside order by c desc, at_) n from x)
        select id, round(max(c) filter (inside and n = 1), 6) in_best, round(max(c) filter (inside and n = 2), 6) in_second, round(max(c) filter (not inside), 6) out_best, max(at_) filter (inside and n = 1) in_label, max(at_) filter (inside and n = 2) second_label from k group by 1"""),
    "levels_three": (shown, f"""with {SCORES}, x as (select id, case when margin < 0 then 'weird' when margin < 0.05 then 'taxonomist' else 'easy' end "level", "label", grp, round(top, 9) score from sc where own is not null),
        dr as (select *, case when "level" = 'weird' then score else ('0x' || substr(md5('13:' || "level" || ':' || id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE end dr from x),
        nt as (select *, row_number() over (partition by "level", "label" order by dr, id) - 1 nth from dr qualify row_number() over (partition by "level", "label" order by dr, id) <= 3),
        tu as (select *, row_number() over (partition by "level", grp order by dr, id) - 1 turn, min(dr) over (partition by "level", "label") fst from nt),
        ky as (select *, case when "level" = 'weird' then turn else nth end k1, case when "level" = 'weird' then dr else fst end k2 from tu),
        g as (select * from ky qualify row_number() over (partition by "level", grp order by k1, k2, dr, id) <= 20) select "level", id, row_number() over (partition by "level" order by k1, k2, dr, id) - 1 place from g"""),
    "planted": (planted, f"""with {POOL}, {IDENTS}, tx as (select id, max(answer) taxon, arg_min(answer, (created_at, seq, answer)) f from idents group by 1), rg as (select p.id, grp, taxon, f from pool p join tx using (id) where status = 'F'),
        ag as (select i.id from idents i join rg using (id) where coalesce(i.user_id <> i.observer_id, false) and answer = taxon group by 1 having count(distinct i.user_id) >= 2)
        select id, grp, taxon, case when id % 2 = 0 then 'cv' else 'typed' end || case when f = taxon then '_hold' else '_fail' end kind from rg where id in (select id from ag)"""),
    "lookalike_first": (first_candidate, f"with {NB}, b as (select n.id, arg_min(o.\"label\", n.place) other from nbs n join r using (id) join r o on o.id = n.nb where o.\"label\" <> r.\"label\" group by 1) select id, other from r left join b using (id) where id % 10 = 0"),
    "join_spatial": (ringed, """with c as (select c_custkey id, (c_custkey * 37 % 1000)::DOUBLE x, (c_custkey * 91 % 1000)::DOUBLE y from customer), t as (select s_suppkey cell, (s_suppkey * 53 % 950)::DOUBLE a, (s_suppkey * 71 % 950)::DOUBLE b from supplier),
        e as (select cell, a x1, b y1, a + 12.5 x2, b + 49.5 y2 from t union all select cell, a + 47.5, b, a, b from t union all select cell, a + 12.5, b + 49.5, a + 47.5, b from t),
        h as (select id, cell, count(*) filter ((y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) n from c, e group by 1, 2), f as (select id, min(cell) cell from h where n % 2 = 1 group by 1) select c.id, cell from c left join f using (id)"""),
    "win_nb_last": (lists_of_parts, f"with {NB}, l as (select id, string_agg(nb::VARCHAR, ',' order by place) nb from nbs group by 1) select id, case when id % 30 = 0 then 'none' else nb end nb from l where id % 50 <> 0"),
    "layout_compact": (layout, f"with {BASE} select id, case when id % 3 = 0 then id * 31 % 1000 + 1000 else id * 31 % 1000 end x, id * 17 % 1000 y from r where id % 7 <> 0 and (id % 4 <> 0 or id % 3 = 0)"),
    "held_out": (held, None),
}
QUERIES = {name: f for name, (f, _) in ENTRIES.items()}
ORACLE = {name: sql for name, (_, sql) in ENTRIES.items() if sql}
