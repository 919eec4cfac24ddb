"""Queries of consensus reviews, masks, logs and re-randomisation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldqueue.operators import analysis, ordering, review, tree, vectors
from fieldqueue.plans.counting import pairs
from fieldqueue.plans.relations import NODES, PATHS, nodes
from fieldqueue.plans.similarity import BASE, rows
from fieldqueue.plans.views import IDENTS, PAIRS, POOL, SERVED, idents, pool, served
from fieldqueue.sources.tables import table


def majority(s, d):
    """Commonest answer of each record and its share."""
    n = idents(s, d).groupBy("id", "answer").agg(F.count("*").alias("n"))
    b = n.groupBy("id").agg(F.max(F.struct("n", "answer")).alias("b"), F.sum("n").alias("t"))
    return b.select(F.col("id").alias("record"), F.col("b.answer").alias("label"), (F.col("b.n") / F.col("t")).alias("posterior"))


def firsts(s, d):
    i = idents(s, d)
    return i.groupBy("id").agg(F.min_by("answer", F.struct("created_at", "seq", "answer")).alias("first")).select(F.col("id").alias("record"), "first", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))


def public(s, d):
    i = idents(s, d)
    return i.groupBy("id").agg(F.max_by("answer", F.struct("created_at", "seq", "answer")).alias("public")).withColumnRenamed("id", "record")


MAJ = """mj as (select id record, max((n, answer)) b, sum(n) t from (select id, answer, count(*) n from idents group by 1, 2) group by 1), maj as (select record, b[2] "label", b[1] / t posterior from mj),
fst as (select id record, arg_min(answer, (created_at, seq, answer)) "first", case when id % 2 = 0 then 'a' else 'b' end source from idents group by 1), pub as (select id record, arg_max(answer, (created_at, seq, answer)) public from idents group by 1)"""


def candidates(s, d):
    """Customers of each order as candidates with probabilities."""
    o = table(s, d, "orders")
    one = o.select((F.floor(F.col("o_orderkey") / 3)).alias("record"), F.concat(F.lit("c"), "o_custkey").alias("taxon"))
    n = one.groupBy("record", "taxon").agg(F.count("*").alias("k"))
    return n.withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy("record"))).select("record", "taxon", "p")


def refinements(s, d):
    o = table(s, d, "orders")
    p = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("taxon"))
    f = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("n"), F.col("o_orderkey") % 25).alias("taxon"))
    return review.collapse_refinements(p, f, tree.lineages(nodes(s, d)))


def masks(s, d):
    """Projects of each record as bits, kept if in any of the first and none of the last."""
    i = idents(s, d)
    bit = F.when(F.col("answer") == "A", 1).when(F.col("answer") == "N", 2).otherwise(4)
    m = i.groupBy("id").agg(F.bit_or(bit).alias("mask"))
    return m.where((F.col("mask").bitwiseAND(F.lit(3)) != 0) & (F.col("mask").bitwiseAND(F.lit(4)) == 0))


def shards(s, d):
    """Shard 0 for the last 90 days and the undated, then runs of 4000 rows by day, newest first."""
    p = pool(s, d)
    end = p.agg(F.max("created_at").alias("end"))
    r = p.crossJoin(F.broadcast(end)).withColumn("recent", F.coalesce(F.datediff("end", "created_at") <= 90, F.lit(True)))
    w = Window.partitionBy("recent", F.year("created_at")).orderBy(F.col("created_at").desc(), "id")
    return r.select("id", F.when(F.col("recent"), 0).otherwise(10000 * F.year("created_at") + F.floor((F.row_number().over(w) - 1) / 4000)).cast("long").alias("shard"))


def margins(s, d):
    """Own and best other cosine to fixed prototypes, the class means of one half of the ids, which has the part of named references."""
    r = rows(s, d)
    protos = vectors.sums(r.where("id % 2 = 0").withColumn("u", vectors.unit("v")), "label", "u").select("label", vectors.unit("total").alias("m"))
    return vectors.reference_scores(r, protos).select("id", F.round(F.col("own") - F.col("other"), 6).alias("margin"))


def log_check(s, d):
    """Leavers by what the log says of them, and whether the two agree within two in a hundred."""
    gone = pool(s, d).where("id % 4 = 1").select("id")
    log = idents(s, d).where("id % 4 = 1 and seq = 1").select("id").distinct()
    return gone.agg(F.count("*").alias("gone")).crossJoin(log.agg(F.count("*").alias("logged"))).withColumn("fine", F.abs(F.col("gone") - F.col("logged")) <= 0.02 * F.col("gone"))


def clade_windows(s, d):
    """Places of the leaves below every region and nation."""
    return review.spans(tree.lineages(nodes(s, d))).where("id not like 'c%'")


QUERIES = {
    "hard_cases": lambda s, d: review.hard_cases(majority(s, d), firsts(s, d), 0.9),
    "detection": lambda s, d: review.detection(majority(s, d), firsts(s, d), public(s, d), 0.5, 0.02).select("source", "n", *[F.round(c, 6).alias(c) for c in ("error", "overturned", "detected")]),
    "kind_table": lambda s, d: majority(s, d).join(firsts(s, d), "record").groupBy("source", "first").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("first")).alias("confirmed")),
    "roll_up": lambda s, d: review.roll_up(candidates(s, d), tree.lineages(nodes(s, d)), 0.6).select("record", "taxon", F.round("p", 6).alias("p")),
    "refinements": refinements,
    "filter_projects": masks,
    "win_recent_shard": shards,
    "win_value_rounds": lambda s, d: review.value_rounds(pool(s, d), "grp", F.when(F.col("status") == "F", 1).when(F.col("status") == "O", 2), F.col("user_id") % 50, 5).select("id", "grp", "place"),
    "text_margin": margins,
    "join_tree_window": clade_windows,
    "log_check": log_check,
    "own_ident": lambda s, d: idents(s, d).where(F.coalesce(F.col("user_id") != F.col("observer_id"), F.lit(True))).groupBy("rank").agg(F.count("*").alias("n")),
}

ORACLE = {
    "hard_cases": f"with {IDENTS}, {MAJ}, w as (select record, case when posterior < 0.9 then 'unsettled' when \"label\" <> \"first\" then 'overturned' end why from maj left join fst using (record)) select * from w where why is not null",
    "detection": f"""with {IDENTS}, {MAJ}, g as (select source, count(*) n, least(greatest((avg(("label" <> "first")::INT) - 0.02) / 0.96, 0), 1) error, avg((public <> "first")::INT) overturned from maj join fst using (record) join pub using (record) where posterior >= 0.5 group by 1)
        select source, n, round(error, 6) error, round(overturned, 6) overturned, round(least(1, overturned / nullif(error, 0)), 6) detected from g""",
    "kind_table": f"with {IDENTS}, {MAJ} select source, \"first\", count(*) n, count(*) filter (\"label\" = \"first\") confirmed from maj join fst using (record) group by 1, 2",
    "roll_up": f"""with recursive {PATHS}, k as (select o_orderkey // 3 record, 'c' || o_custkey taxon, count(*) k from orders group by 1, 2), c as (select *, k / sum(k) over (partition by record) p from k), x as (select record, p, path, unnest(range(0, len(path))) depth from c join paths on id = taxon),
        s as (select record, depth, path[depth + 1] node, sum(p) p from x group by 1, 2, 3 having sum(p) >= 0.6::DOUBLE - 1e-9), b as (select record, max((depth, p, node)) b from s group by 1) select record, b[3] taxon, round(b[2], 6) p from b""",
    "refinements": f"with recursive {PATHS} select o_orderkey id, case when list_contains(path, 'n' || (o_orderkey % 25)) then 'n' || (o_orderkey % 25) else 'c' || o_custkey end taxon from orders left join paths on id = 'c' || o_custkey",
    "filter_projects": f"with {IDENTS}, m as (select id, bit_or(case answer when 'A' then 1 when 'N' then 2 else 4 end) mask from idents group by 1) select id, mask from m where mask & 3 <> 0 and mask & 4 = 0",
    "win_recent_shard": f"with {POOL}, r as (select id, created_at, date_diff('day', created_at::DATE, (select max(created_at) from pool)::DATE) <= 90 recent from pool) select id, (case when recent then 0 else 10000 * year(created_at) + (row_number() over (partition by recent, year(created_at) order by created_at desc, id) - 1) // 4000 end)::BIGINT shard from r",
    "win_value_rounds": f"with {POOL}, t as (select id, grp, case status when 'F' then 1 when 'O' then 2 end t, user_id % 50 r from pool), k as (select *, (row_number() over (partition by grp, t order by r, id) - 1) // 5 rd from t) select id, grp, row_number() over (partition by grp order by t is null, t, rd, r, id)::INT place from k",
    "text_margin": f"""with {BASE}, u as (select id, "label", list_transform(v, lambda y: y / sqrt(list_dot_product(v, v))) u from r), e as (select "label", unnest(u) x, unnest(range(0, len(u))) i from u where id % 2 = 0), t as (select "label", i, sum(x) s from e group by 1, 2), m as (select "label" nm, list(s order by i) m from t group by 1)
        select id, round(max(list_cosine_similarity(u, m)) filter (nm = "label") - max(list_cosine_similarity(u, m)) filter (nm <> "label"), 6) margin from u, m group by 1""",
    "join_tree_window": f"with recursive {PATHS}, lf as (select path, row_number() over (order by path[1], array_to_string(path, '/')) - 1 p from paths where id not in (select parent from nodes where parent is not null)), x as (select unnest(path) id, p from lf) select id, min(p) lo, max(p) hi from x where id not like 'c%' group by 1",
    "log_check": f"with {IDENTS}, a as (select count(*) gone from orders where o_orderkey % 4 = 1), b as (select count(distinct id) logged from idents where id % 4 = 1 and seq = 1) select gone, logged, abs(gone - logged) <= 0.02 * gone fine from a, b",
    "own_ident": f"with {IDENTS} select rank, count(*) n from idents where coalesce(user_id <> observer_id, true) group by 1",
}
