"""Queries of surprise at places and of priors by rank."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldqueue.operators import surprise
from fieldqueue.plans.summaries import points
from fieldqueue.sources.tables import table


def taxa(s, d):
    """Names of four ranks, from the parts: 40 species in 13 genera, 5 families and 2 orders."""
    k = (F.col("p_partkey") % 40).cast("long")
    ids = table(s, d, "part").select(k.alias("s")).distinct().select(
        (F.lit(100) + F.col("s") % 13 % 5 % 2).alias("o"), (F.lit(200) + F.col("s") % 13 % 5).alias("f"), (F.lit(500) + F.col("s") % 13).alias("g"), (F.lit(1000) + F.col("s")).alias("t")
    )
    above = {"o": (40, []), "f": (30, ["o"]), "g": (20, ["o", "f"]), "t": (10, ["o", "f", "g"])}
    rows = [ids.select(F.col(c).alias("taxon_id"), F.lit(level).alias("rank_level"), (F.array(*line) if line else F.lit(None)).cast("array<bigint>").alias("ancestry")).distinct() for c, (level, line) in above.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def sightings(s, d):
    """Orders as records in a box, most named by species, some by genus or family, some not at all."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(c % 23 == 0, F.lit(None)).when(c % 19 == 0, 200 + c % 5).when(c % 17 == 0, 500 + c % 13).otherwise(1000 + c % 40)
    grade = F.when(F.col("o_orderstatus") == "F", "research").when(F.col("o_orderstatus") == "O", "needs_id").otherwise("casual")
    lat = F.when(k % 71 != 0, 48 + k * 7919 % 1000 / 100)
    return table(s, d, "orders").select(k.alias("id"), lat.alias("lat"), (-130 + k * 104729 % 1500 / 100).alias("lon"), name.cast("long").alias("taxon_id"), grade.alias("quality_grade"), F.col("o_orderdate").cast("date").alias("observed_on"), F.when(k % 5 != 0, k * 31 % 4000).cast("double").alias("positional_accuracy"))


def pool(s, d):
    return sightings(s, d).where("id % 8 = 0").select("id", "lat", "lon", "taxon_id")


def refs(s, d):
    return sightings(s, d).where("id % 8 <> 0").withColumnsRenamed({"lat": "latitude", "lon": "longitude"})


BEFORE = "1997-07-01"


def geo(s, d):
    found = surprise.geo_surprise(pool(s, d), refs(s, d), taxa(s, d), BEFORE, h=200.0, error=1e-9)
    return found.select("id", F.round("surprise", 6).alias("surprise"), "n_ref")


def chain(s, d):
    p = surprise.prior_chain(pool(s, d), refs(s, d), taxa(s, d), BEFORE, start="1992-06-01", least=60)
    return p.select("id", F.round("prior", 6).alias("prior"), "prior_rank")


def skipped(s, d):
    p = surprise.prior_chain(pool(s, d), refs(s, d), taxa(s, d), BEFORE, start="1992-06-01", least=60)
    near = pool(s, d).select("id", (F.col("id") % 97 / 97).alias("surprise"))
    out = surprise.with_prior(near, p, 0.45)
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("surprise", "prior")], "skip")


def tails(s, d):
    p = points(s, d)
    t = surprise.tail(p.where("id % 3 <> 0"), p.where("id % 3 = 0"), 5.0, error=1e-9)
    return t.select("id", F.round("tail", 6).alias("tail"))


QUERIES = {"geo_surprise": geo, "prior": chain, "prior_skip": skipped, "tail_prob": tails}

NAMES = """sp as (select distinct p_partkey % 40 s from part), nm as (select 100 + s % 13 % 5 % 2 o, 200 + s % 13 % 5 f, 500 + s % 13 g, 1000 + s t from sp),
taxa as (select distinct o taxon_id, 40 rank_level, []::BIGINT[] line from nm union select distinct f, 30, [o] from nm union select distinct g, 20, [o, f] from nm union select t, 10, [o, f, g] from nm),
steps as (select taxon_id, unnest(list_append(line, taxon_id)) above, unnest(range(len(line) + 1)) depth from taxa),
rk as (select s.taxon_id, arg_max(above, depth) filter (rank_level = 10) species, arg_max(above, depth) filter (rank_level = 20) genus, arg_max(above, depth) filter (rank_level = 30) family, arg_max(above, depth) filter (rank_level = 40) "order"
       from steps s join (select taxon_id a, rank_level from taxa) on above = a group by 1),
si as (select o_orderkey id, case when o_orderkey % 71 <> 0 then 48 + (o_orderkey * 7919 % 1000) / 100.0::DOUBLE end lat, -130 + (o_orderkey * 104729 % 1500) / 100.0::DOUBLE lon,
              case when o_custkey % 23 = 0 then null when o_custkey % 19 = 0 then 200 + o_custkey % 5 when o_custkey % 17 = 0 then 500 + o_custkey % 13 else 1000 + o_custkey % 40 end taxon_id,
              case o_orderstatus when 'F' then 'research' when 'O' then 'needs_id' else 'casual' end grade, o_orderdate::DATE seen, case when o_orderkey % 5 <> 0 then o_orderkey * 31 % 4000 end off from orders),
pl as (select * from si where id % 8 = 0), rf as (select * from si where id % 8 <> 0)"""
#: Densities of all points by comparing every pair of a key: rows pt (key, id, x, y, ref), width h.
PAIRS = """dn as (select a.key, a.id, a.ref, round((case when a.ref then (sum(exp(-(pow(a.x - r.x, 2) + pow(a.y - r.y, 2)) / (2 * {h} * {h}))) - 1) * any_value(n) / greatest(any_value(n) - 1, 1) else coalesce(sum(exp(-(pow(a.x - r.x, 2) + pow(a.y - r.y, 2)) / (2 * {h} * {h}))), 0) end)::DOUBLE, 9) d
       from pt a left join (select * from pt where ref and x is not null) r on r.key = a.key left join (select key, count(*) n from pt where ref and x is not null group by 1) n on n.key = a.key where a.x is not null group by a.key, a.id, a.ref),
ct as (select key, count(*) n from pt where ref and x is not null group by 1),
tl as (select p.id, p.key, coalesce(n, 0) n, case when coalesce(n, 0) < 5 then 1 when p.x is not null then (select count(*) from dn b where b.ref and b.key = p.key and b.d > (select d from dn q where not q.ref and q.id = p.id)) / n end t from pt p left join ct on ct.key = p.key where not p.ref)"""
PRIORS = f"""bx as (select min(lat) a, max(lat) b, min(lon) c, max(lon) e from pl), rr as (select (grade = 'research')::INT rg, rk.* from rf join rk using (taxon_id), bx where grade in ('research', 'needs_id') and lat between a and b and lon between c and e and seen >= '1992-06-01' and seen < '{BEFORE}'),
g1 as (select genus, avg(rg) a from rr where genus is not null group by 1 having count(*) >= 60), g2 as (select family, avg(rg) b from rr where family is not null group by 1 having count(*) >= 60), g3 as (select "order", avg(rg) c from rr where "order" is not null group by 1 having count(*) >= 60),
pr as (select id, coalesce(a, b, c) prior, case when a is not null then 'genus' when b is not null then 'family' when c is not null then 'order' end prior_rank from pl left join rk using (taxon_id) left join g1 using (genus) left join g2 using (family) left join g3 using ("order"))"""
X, Y = "lon * 111.32 * cos(radians(54.0::DOUBLE))", "lat * 110.57"
ORACLE = {
    "geo_surprise": f"""with {NAMES}, pk as (select id, coalesce(species, genus) key, {X} x, case when lat is not null then {Y} end y from pl left join rk using (taxon_id)),
        rg as (select id, unnest(list_distinct(list_filter([species, genus], lambda v: v is not null))) key, {X} x, {Y} y from rf join rk using (taxon_id) where grade = 'research' and seen < '{BEFORE}' and (off is null or off <= 2000) and lat is not null),
        pt as (select key, id, case when y is not null then x end x, y, false ref from pk where key is not null union all select key, id, x, y, true from rg where key in (select key from pk)), {PAIRS.format(h="200.0::DOUBLE")}
        select pk.id, round(t, 6) surprise, tl.n n_ref from pk left join tl on tl.id = pk.id""",
    "prior": f"with {NAMES}, {PRIORS} select id, round(prior, 6) prior, prior_rank from pr",
    "prior_skip": f"with {NAMES}, {PRIORS} select id, round(case when coalesce(prior < 0.45, false) then null else (id % 97) / 97 end, 6) surprise, round(prior, 6) prior, coalesce(prior < 0.45, false) skip from pr",
    "tail_prob": f"""with pt as (select c_nationkey key, c_custkey id, (c_custkey * 7919 % 1000) / 10.0::DOUBLE x, (c_custkey * 104729 % 1000) / 10.0::DOUBLE y, c_custkey % 3 <> 0 ref from customer), {PAIRS.format(h="5.0::DOUBLE")} select id, round(t, 6) tail from tl""",
}
