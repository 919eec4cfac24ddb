"""Queries of trees, joins, facets, edges and places."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from fieldqueue.functions.hashing import keyed_bucket
from fieldqueue.operators import facets, geo, tree
from fieldqueue.plans.batching import ARM_SQL, KEY
from fieldqueue.plans.views import IDENTS, POOL, idents, pool
from fieldqueue.sources.tables import table


def nodes(s, d):
    """Regions, nations and customers as a tree of text ids."""
    r = table(s, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    n = table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    c = table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    return r.unionByName(n).unionByName(c)


NODES = "nodes as (select 'r' || r_regionkey id, null parent from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer)"
PATHS = f"{NODES}, paths as (select id, [id] path from nodes where parent is null union all select n.id, list_append(p.path, n.id) from nodes n join paths p on n.parent = p.id)"


def changed(s, d):
    """The lineage that each part's type had (its words) and has now (one word changed, less or more)."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_type", " ").alias("now"))
    k = F.col("id") % 5
    then = F.when(k == 0, F.col("now")).when(k == 1, F.slice("now", 1, 1)).when(k == 2, F.concat("now", F.array(F.lit("X")))).when(k == 3, F.array(F.lit("X")))
    return p.withColumn("then", then)


def places(s, d):
    c = table(s, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), (48 + F.col("c_custkey") * 7 % 1200 / 100).alias("lat"), (-139 + F.col("c_custkey") * 13 % 2500 / 100).alias("lon"))


def cells(s, d):
    u = table(s, d, "supplier")
    return u.select(F.col("s_suppkey").alias("cell"), (48 + F.col("s_suppkey") * 11 % 1200 / 100).alias("lat"), (-139 + F.col("s_suppkey") * 29 % 2500 / 100).alias("lon"))


def near(s, d):
    return geo.nearest_cell(places(s, d), cells(s, d), 60.0)


def votes(s, d):
    li = table(s, d, "lineitem")
    path = F.when(F.col("l_linenumber") % 3 == 0, F.array("l_returnflag")).otherwise(F.array("l_returnflag", F.concat("l_returnflag", "l_linestatus")))
    return li.select(F.col("l_orderkey").alias("id"), path.alias("path"))


def flagged(s, d):
    li = table(s, d, "lineitem")
    bits = (F.col("l_returnflag") == "R").cast("int") + 2 * (F.col("l_discount") > 0.05).cast("int") + 4 * (F.col("l_tax") > 0.04).cast("int")
    return li.select("l_orderkey", "l_linenumber", bits.alias("flags"), facets.nibble(F.col("l_quantity") - 20).alias("nibble"))


def pairs(s, d):
    li = table(s, d, "lineitem")
    e = li.select(F.col("l_suppkey").alias("x"), (F.col("l_partkey") % 100 + 1).alias("y"), "l_shipdate").where("x <> y")
    g = e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.year("l_shipdate").cast("string").alias("kind"))
    return g.groupBy("a", "b").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"), F.count("*").alias("n")).where("n >= 2")


def slugs(s, d):
    p = table(s, d, "part")
    own = p.where("p_partkey % 40 = 0").select(F.col("p_type").alias("name"), F.col("p_brand").alias("slug"), F.lit(True).alias("own"))
    return tree.unambiguous(p.where("p_partkey % 10 <> 0").select(F.col("p_type").alias("name"), F.col("p_brand").alias("slug"), F.lit(False).alias("own")).unionByName(own))


def monthly(s, d):
    """Events by type and month day by day bins, with every type and day of the span."""
    e = table(s, d, "events").select(F.to_date("ts").alias("day"), "event_type")
    span = e.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = span.select(F.explode(F.sequence("a", "b")).alias("day")).crossJoin(e.select("event_type").distinct())
    return spine.join(e.groupBy("day", "event_type").agg(F.count("*").alias("n")), ["day", "event_type"], "left").select("day", "event_type", F.coalesce("n", F.lit(0)).alias("n"))


def urls(s, d):
    p = table(s, d, "pages")
    part = lambda k: F.regexp_extract("url", r"^(\w+)://([^/]+)(/[^?#]*)?", k)
    return p.select("page_id", part(1).alias("scheme"), F.lower(part(2)).alias("host"), part(3).alias("path"))


def flat(s, d):
    """Nested records, a record an order with its lines, made flat again: first line, number of lines, dearest line."""
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice"))).alias("lines"))
    best = F.array_max(F.transform("lines", lambda x: F.struct(x["l_extendedprice"].alias("p"), x["l_linenumber"].alias("n"))))
    return li.where(F.size("lines") >= 2).select(F.col("l_orderkey").alias("id"), F.get("lines", F.lit(0))["l_partkey"].alias("first_part"), F.size("lines").alias("n"), best["p"].alias("dearest"))


QUERIES = {
    "keyed_arm": lambda s, d: pool(s, d).select("id", keyed_bucket(KEY, F.col("id").cast("string"), 3).alias("arm")),
    "strata": lambda s, d: pool(s, d).select("id", F.concat_ws("|", F.coalesce("grp", F.lit("Unknown")), F.coalesce((F.crc32(F.col("user_id").cast("string")) % 3).cast("string"), F.lit("na"))).alias("stratum")),
    "lineage": lambda s, d: tree.lineages(nodes(s, d)).select("id", F.array_join("path", "/").alias("path")),
    "descendants": lambda s, d: tree.lineages(nodes(s, d)).where(F.arrays_overlap("path", F.array(F.lit("r1"), F.lit("n3")))).select("id"),
    "tree_counts": lambda s, d: tree.counts_below(table(s, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("id")).join(tree.lineages(nodes(s, d)), "id")),
    "relation": lambda s, d: changed(s, d).select("id", tree.relation(F.col("then"), F.col("now")).alias("relation")),
    "lca_level": lambda s, d: changed(s, d).where("then is not null").select("id", tree.common_depth(F.col("then"), F.col("now")).alias("depth")),
    "community_taxon": lambda s, d: tree.community(votes(s, d)).select("id", "node", F.round("score", 6).alias("score")),
    "join_sdm": slugs,
    "foodweb_pairs": lambda s, d: tree.adjacency(table(s, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 200).alias("b"))).where("place <= 5"),
    "host_lift": pairs,
    "metaweb": lambda s, d: pairs(s, d).select("a", "b", F.round(1 - F.pow(F.lit(0.5), "n"), 3).alias("p")).where("a % 7 <> 0"),
    "join_nearest": lambda s, d: near(s, d).select("id", "cell", F.round("km", 4).alias("km")),
    "km_code": lambda s, d: near(s, d).where("km is not null").select("id", geo.unit_code(F.col("km")).alias("code")),
    "quant16": lambda s, d: places(s, d).select("id", geo.quantised(F.col("lat"), F.lit(48.0), F.lit(60.0)).alias("y"), geo.quantised(F.col("lon"), F.lit(-139.0), F.lit(-114.0)).alias("x")),
    "filter_groups": lambda s, d: pool(s, d).where(facets.keep(["1-URGENT", "2-HIGH"], ["5-LOW"], [F.col("user_id") % 10 == 0])).select("id"),
    "filter_rest": lambda s, d: pool(s, d).where(facets.dates("created_at", date(1997, 3, 1), date(1994, 2, 1), 0b100000100101)).select("id"),
    "flags": flagged,
    "filter_bits": lambda s, d: flagged(s, d).where(facets.bits(1, 4, F.col("flags"))).select("l_orderkey", "l_linenumber"),
    "filter_oneid": lambda s, d: idents(s, d).groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("answer") == "N").alias("agree")).where(facets.one_short(F.col("agree"), F.col("n")) & ~(3 * F.col("agree") > 2 * F.col("n"))).select("id"),
    "align_totals": monthly,
    "photo_columns": urls,
    "scan_flatten": flat,
    "src_props": lambda s, d: table(s, d, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n")),
}

AT = "48 + {k} * {a} % 1200 / 100.0::DOUBLE lat, -139 + {k} * {b} % 2500 / 100.0::DOUBLE lon"
KM = "2 * 6371.0088 * asin(least(sqrt(pow(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - p.lon) / 2), 2)), 1.0))"
NEAR = f"p as (select c_custkey id, {AT.format(k='c_custkey', a=7, b=13)} from customer), c as (select s_suppkey cell, {AT.format(k='s_suppkey', a=11, b=29)} from supplier), x as (select id, cell, {KM} km from p, c), b as (select id, arg_min(cell, (km, cell)) cell, min(km) km from x where km <= 60 group by 1), near as (select p.id, cell, km from p left join b using (id))"
CHANGED = "q as (select p_partkey id, string_split(p_type, ' ') now_ from part), changed as (select id, now_, case id % 5 when 0 then now_ when 1 then now_[1:1] when 2 then list_append(now_, 'X') when 3 then ['X'] end then_ from q)"
FLAGS = "f as (select l_orderkey, l_linenumber, (l_returnflag = 'R')::INT + 2 * (l_discount > 0.05)::INT + 4 * (l_tax > 0.04)::INT flags, least(greatest(l_quantity - 20, 0), 15)::INT nibble from lineitem)"
EDGES = "e as (select l_suppkey x, l_partkey % 100 + 1 y, l_shipdate from lineitem where l_suppkey <> l_partkey % 100 + 1), g as (select least(x, y) a, greatest(x, y) b, year(l_shipdate)::VARCHAR kind from e), pr as (select a, b, string_agg(distinct kind, ',' order by kind) kinds, count(*) n from g group by 1, 2 having count(*) >= 2)"
CRC = """st as (select list(c order by i) t from (select i, list_reduce(list_prepend(i, range(8)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) c from range(256) s(i))),
    us as (select user_id, user_id::VARCHAR s from (select distinct user_id from pool where user_id is not null)),
    cr as (select user_id, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(s)), lambda j: unicode(substr(s, j + 1, 1))::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 3 k from us, st)"""
ORACLE = {
    "strata": f"with {POOL}, {CRC} select id, coalesce(grp, 'Unknown') || '|' || coalesce(k::VARCHAR, 'na') stratum from pool left join cr using (user_id)",
    "keyed_arm": f"select o_orderkey id, list_position(['control', 'novelty', 'recency'], {ARM_SQL}) - 1 arm from orders",
    "lineage": f"with recursive {PATHS} select id, array_to_string(path, '/') path from paths",
    "descendants": f"with recursive {PATHS} select id from paths where list_has_any(path, ['r1', 'n3'])",
    "tree_counts": f"with recursive {PATHS}, x as (select path, unnest(range(0, len(path))) depth from orders join paths on id = 'c' || o_custkey) select path[depth + 1] node, count(*) filter (depth = len(path) - 1) own, count(*) below, max(len(path) - 1 - depth)::INT deepest from x group by 1",
    "relation": f"with {CHANGED} select id, case when then_ is null then 'none' when then_ = now_ then 'same' when len(then_) < len(now_) and now_[1:len(then_)] = then_ then 'refined' when len(then_) > len(now_) and then_[1:len(now_)] = now_ then 'coarsened' else 'corrected' end relation from changed",
    "lca_level": f"with {CHANGED} select id, coalesce((select min(i) - 1 from range(1, least(len(then_), len(now_)) + 1) t(i) where then_[i] <> now_[i]), least(len(then_), len(now_)))::INT depth from changed where then_ is not null",
    "community_taxon": """with v as (select l_orderkey id, case when l_linenumber % 3 = 0 then [l_returnflag] else [l_returnflag, l_returnflag || l_linestatus] end path from lineitem), x as (select id, path, unnest(range(0, len(path))) depth from v), a as (select id, depth, path[depth + 1] node, count(*) n from x group by 1, 2, 3),
        g as (select a.*, (select count(*) from v where v.id = a.id and not list_contains(v.path, a.node) and not exists (select 1 from x where x.id = a.id and x.path[x.depth + 1] = a.node and list_contains(x.path[1:x.depth], v.path[-1]))) against from a),
        f as (select *, n + against reached from g where n >= 2 and 3 * n > 2 * (n + against)), b as (select id, max((depth, node, n, reached)) m from f group by 1) select id, m[2] node, round(m[3] / m[4], 6) score from b""",
    "join_sdm": "with n as (select p_type \"name\", p_brand slug, false own from part where p_partkey % 10 <> 0 union all select p_type, p_brand, true from part where p_partkey % 40 = 0), b as (select \"name\", count(distinct slug) k, min(slug) slug, min(slug) filter (own) owner from n group by 1), o as (select \"name\", case when k = 1 then slug else owner end slug from b) select * from o where slug is not null",
    "foodweb_pairs": "with e as (select l_suppkey a, l_partkey % 200 b, count(*) n from lineitem where l_suppkey <> l_partkey % 200 group by 1, 2), u as (select a node, 'out' role, b partner, n from e union all select b, 'in', a, n from e) select *, row_number() over (partition by node, role order by n desc, partner)::INT place from u qualify place <= 5",
    "host_lift": f"with {EDGES} select * from pr",
    "metaweb": f"with {EDGES} select a, b, round(1 - pow(0.5::DOUBLE, n), 3) p from pr where a % 7 <> 0",
    "join_nearest": f"with {NEAR} select id, cell, round(km, 4) km from near",
    "km_code": f"with {NEAR} select id, (case when km < 16 then floor(km * 4 + 0.5) when km < 100 then floor(km - 16 + 0.5) + 64 when km < 600 then floor((km - 100) / 5 + 0.5) + 148 else 255 end)::INT code from near where km is not null",
    "quant16": f"with {NEAR} select id, round_even((lat - 48) / 12 * 65535, 0)::INT y, round_even((lon + 139) / 25 * 65535, 0)::INT x from p",
    "filter_groups": f"with {POOL} select id from pool where (grp in ('1-URGENT', '2-HIGH') or user_id % 10 = 0) and grp <> '5-LOW'",
    "filter_rest": f"with {POOL} select id from pool where created_at >= date '1994-02-01' and created_at::DATE <= date '1997-03-01' and ((1 << (month(created_at) - 1)::INT) & {0b100000100101}) <> 0",
    "flags": f"with {FLAGS} select * from f",
    "filter_bits": f"with {FLAGS} select l_orderkey, l_linenumber from f where flags & 1 = 1 and flags & 4 = 0",
    "filter_oneid": f"with {IDENTS}, g as (select id, count(*) n, count(*) filter (answer = 'N') agree from idents group by 1) select id from g where 3 * (agree + 1) > 2 * (n + 1) and not 3 * agree > 2 * n",
    "align_totals": "with e as (select ts::DATE \"day\", event_type from events), s as (select unnest(generate_series((select min(\"day\") from e), (select max(\"day\") from e), interval 1 day))::DATE \"day\"), t as (select distinct event_type from e), n as (select \"day\", event_type, count(*) n from e group by 1, 2) select \"day\", event_type, coalesce(n, 0) n from s cross join t left join n using (\"day\", event_type)",
    "photo_columns": r"select page_id, regexp_extract(url, '^(\w+)://([^/]+)(/[^?#]*)?', 1) scheme, lower(regexp_extract(url, '^(\w+)://([^/]+)(/[^?#]*)?', 2)) host, regexp_extract(url, '^(\w+)://([^/]+)(/[^?#]*)?', 3) path from pages",
    "scan_flatten": "select l_orderkey id, arg_min(l_partkey, (l_linenumber, l_partkey, l_extendedprice)) first_part, count(*)::INT n, max(l_extendedprice) dearest from lineitem group by 1 having count(*) >= 2",
    "src_props": "select (props::JSON->>'k')::INT k, count(*) n from events group by 1",
}
