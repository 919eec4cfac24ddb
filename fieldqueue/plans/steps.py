"""Queries of single steps: sources, filters, lookups, scalars, logs and the index."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldqueue.functions.hashing import hmac_sha256
from fieldqueue.operators import analysis, batches, facets, geo, ordering, state
from fieldqueue.plans.batching import ARMS, KEY, build_batches, hmac_sql
from fieldqueue.plans.batching import ORACLE as BATCHES
from fieldqueue.plans.counting import COLS, pairs
from fieldqueue.plans.relations import AT, NEAR, cells, places
from fieldqueue.plans.similarity import BASE, SCORES, rows, scores
from fieldqueue.plans.views import IDENTS, PAIRS, POOL, RANKS, SERVED, WINDOW, idents, pool, served
from fieldqueue.sources import tables
from fieldqueue.sources.shared import kept
from fieldqueue.sources.tables import table

DAY = "1997-01-01"


def half_open(rows, start: str, cutoff: str):
    """Rows created in [start, cutoff)."""
    if cutoff <= start:
        raise ValueError("the cutoff must be later than the start")
    return rows.where((F.col("created_at") >= F.lit(start).cast("timestamp")) & (F.col("created_at") < F.lit(cutoff).cast("timestamp")))


def lines(s, d):
    p = pool(s, d).select("id", "grp", "created_at")
    both = p.withColumn("line", F.col("id") * 2).unionByName(p.where("id % 3 = 0").withColumn("grp", F.lit("again")).withColumn("line", F.col("id") * 2 + 1))
    path = tables.written_as(both.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")), "json")
    return tables.first_of_lines(path, s, "id long, grp string, created_at timestamp, line long", DAY).select("id", "grp")


def taxa(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("taxon_id"), (F.col("p_size") * 10.0).alias("rank_level"))
    return s.read.schema("taxon_id long, rank_level double").csv(tables.written_as(p, "csv", sep="\t"), sep="\t")


def exports(s, d):
    """The last answer of each login to each record, in the order of the files' lines."""
    i = idents(s, d).where("user_id is not null").select(F.concat(F.lit("  u"), "user_id", F.lit(" ")).alias("login"), F.col("id").alias("record"), "answer", F.struct("created_at", "seq", "answer").alias("at"))
    return i.groupBy(F.trim("login").alias("login"), "record").agg(F.max_by("answer", "at").alias("answer"))


def fallback(s, d):
    """Each row's store: that of its group, else the one for all groups."""
    own = rows(s, d).select("label").distinct().where("label < 5").select("label", F.concat(F.lit("store-"), "label").alias("own"))
    return rows(s, d).join(own, "label", "left").select("id", F.coalesce("own", F.lit("store-*")).alias("store"))


def blocks(s, d, n: int = 5, size: int = 200, seed: int = 9):
    """Blocks of consecutive ids after starts drawn evenly between the least and the greatest id."""
    ids = pool(s, d).select("id")
    draw = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("block"))), 1, 13), 16, 10).cast("long"), F.col("high") - F.col("low"))
    starts = ids.agg(F.min("id").alias("low"), F.max("id").alias("high")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("block", (F.col("low") + draw).alias("start")).collect()
    out = None
    for r in starts:  # few blocks; each is the head of an ordered scan
        one = ids.where(F.col("id") > r["start"]).orderBy("id").limit(size).select(F.lit(r["block"]).alias("block"), "id")
        out = one if out is None else out.unionByName(one)
    return out


def day_log(s, d, days=("2026-01-01", "2026-01-02")):
    """What two builds have served: batches with letters in place of lists."""
    b = build_batches(s, d)
    label = F.element_at(F.create_map(*[F.lit(x) for a, l in zip(ARMS, "ABC") for x in (a, l)]), F.col("arm"))
    out = b.select(label.alias("label"), "group", F.regexp_extract("batch_id", "([^-]+)$", 1).cast("long").alias("batch_index"), "position", "id")
    return out.withColumn("build_date", F.explode(F.array(*map(F.lit, days))))


def appended(s, d):
    log = day_log(s, d).where("build_date = '2026-01-01' or id % 2 = 0")
    fresh = day_log(s, d).where("build_date = '2026-01-02' and id % 3 = 0")
    return state.append_served(log, fresh).groupBy("build_date", "label").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def rebuilt(pool, key, size, most):
    """Batches of a pool's lists by key, newest first."""
    order = [F.col("created_at").desc_nulls_last(), F.col("id").desc()]
    return batches.build_batches(batches.assign_keyed(pool.withColumnRenamed("grp", "group"), ARMS, key), order, size, most).select("arm", "batch_id", "position", "id")


def replayed(s, d):
    """A stored log in which some positions were changed and some rows lost, against the build repeated from its record: what differs, by side."""
    p = pool(s, d).select("id", "grp", "created_at")
    record = state.recorded(p, KEY, {"size": 50, "most": 20})
    log = kept(rebuilt(p, KEY, 50, 20).where("id % 41 <> 3").withColumn("position", F.when(F.col("id") % 40 == 7, F.col("position") + 1).otherwise(F.col("position")).cast("int")))
    return state.replay(record, log, p, KEY, rebuilt).groupBy("side").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def study(s, d):
    """For each list's letter and group the batches in order, each its ids; letters stand for lists, whose names don't appear."""
    b = day_log(s, d).where("build_date = '2026-01-01'")
    ids = b.groupBy("label", "group", "batch_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda r: r["id"].cast("string")), ",").alias("ids"))
    return ids


def batch_urls(s, d):
    """A link for each batch; one of 8000 characters or more is an error."""
    url = F.concat(F.lit("https://example.org/review?id="), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ","))
    b = build_batches(s, d).groupBy("batch_id").agg(url.alias("url"))
    return b.withColumn("url", F.when(F.length("url") < 8000, F.col("url")).otherwise(F.raise_error(F.lit("a link is too long")).cast("string")))


def accuracy(s, d):
    """Class of a position's accuracy in metres; one that is kept secret shows with the unknown only."""
    a = pool(s, d).select("id", F.when(F.col("id") % 7 != 0, F.col("user_id") % 2000).alias("m"), (F.col("id") % 5 == 0).alias("obscured"))
    kind = F.when(F.col("m").isNull(), "unknown").when(F.col("m") <= 10, "10 m").when(F.col("m") <= 100, "100 m").when(F.col("m") <= 1000, "1 km").otherwise("known")
    return a.select("id", kind.alias("class"), (F.col("m").isNotNull() & ~F.col("obscured")).alias("shown"))


def scope(s, d):
    """Whether a record's lineage meets a set of roots; unknown if it doesn't and is incomplete."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_type", " ").alias("path"), (F.col("p_size") % 3 != 0).alias("complete"))
    return p.select("id", F.when(F.arrays_overlap("path", F.array(F.lit("STANDARD"), F.lit("BRASS"))), True).when(F.col("complete"), False).alias("member"))


def live(s, d):
    """Hits by what hides them: an excluded taxon, none of those asked for, no longer open, or nothing."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_type", " ").alias("path"), (F.col("p_size") % 4).alias("state"))
    has = lambda *n: F.arrays_overlap("path", F.array(*map(F.lit, n)))
    why = F.when(has("TIN"), "excluded").when(~has("STANDARD", "SMALL", "LARGE"), "not asked for").when(F.col("state") == 0, "missing").when(F.col("state") == 1, "not open").otherwise("kept")
    return p.groupBy(why.alias("why")).agg(F.count("*").alias("n"))


def range_filter(s, d):
    """Cards of a range mode: far is 50 km and more outside; a card fits if its cell is one of the suggestion's."""
    c = places(s, d).select("id", (F.col("id") * 17 % 120).alias("out_km"), (F.col("id") % 10).alias("cell"), F.array(*[(F.col("id") * k % 10) for k in (3, 7)]).alias("cells"))
    return c.select("id", (F.col("out_km") >= 50).alias("far"), F.array_contains("cells", F.col("cell")).alias("fits"))


def per_species(s, d):
    """The kept list cut to the last three of each answer and group, in list order."""
    p = idents(s, d).join(pool(s, d).select("id", "grp"), "id").where("seq = 1").groupBy("id", "grp").agg(F.max("answer").alias("answer"))
    return ordering.place(p, ["grp", "answer"], [F.col("id").desc()], "_p").where("_p < 3").select("id", "grp", "answer")


def parts_of_index(s, d):
    """Vectors in two parts, the second newer, with some ids in both."""
    r = rows(s, d).select("id", F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("x"))
    return r.where("id % 3 <> 0").withColumn("part", F.lit("a")).unionByName(r.where("id % 2 = 0").withColumn("x", F.col("x") + 1).withColumn("part", F.lit("b")))


def index_appended(s, d):
    base = parts_of_index(s, d).where("part = 'a'")
    fresh = rows(s, d).where("id % 3 = 0").select("id", F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("x"))
    return state.append_part(base, fresh, "c").groupBy("part").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def sided(s, d):
    r = pool(s, d).select("id", F.col("status").alias("grade"), F.col("created_at").alias("updated_at"))
    return state.changes(r, F.lit(DAY).cast("timestamp"), ["O", "P"]).groupBy("side").agg(F.count("*").alias("n"), F.max("newest").alias("newest"))


def queue(s, d):
    """Records with the days to research grade (null: never), their grade now, and how their taxon has changed."""
    p = pool(s, d)
    kind = F.element_at(F.array(*map(F.lit, ("same", "corrected", "coarsened", "refined", "none"))), (F.col("id") % 5 + 1).cast("int"))
    return p.select("id", "created_at", F.col("score").alias("s"), F.when(F.col("id") % 3 != 0, F.col("user_id") % 90).alias("days"), F.when(F.col("status") == "F", "research").otherwise("needs_id").alias("grade"), kind.alias("relation"))


def outcome_columns(q):
    """The seven outcomes of a record as 0 and 1; what is unknown is 0."""
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    rel = F.col("relation")
    return {"fast": yes(F.col("days") <= 30), "slow": yes(F.col("days") > 30), "stuck": yes(F.col("grade") != "research"), "corrected": yes(rel == "corrected"), "coarsened": yes(rel == "coarsened"), "misid": yes(rel.isin("corrected", "coarsened")), "refined": yes(rel == "refined")}


def wanted(s, d):
    """What an index lacks of the pool: with a photo, oldest first, no more than so many; and what was passed over, as counts."""
    p = pool(s, d).withColumn("photo", F.col("id") % 11 != 0)
    missing = p.join(rows(s, d).select("id"), "id", "left_anti")
    new = missing.where("photo").orderBy("created_at", "id").limit(500)
    return new.agg(F.lit("planned").alias("what"), F.count("*").alias("n"), F.sum("id").alias("ids")).unionByName(missing.where("not photo").agg(F.lit("no photo").alias("what"), F.count("*").alias("n"), F.sum("id").alias("ids")))


def mixed(s, d):
    """Sampled records with planted ones among them, in a seeded order; a record in both is an error."""
    a = pool(s, d).where("id % 20 = 0").select("id", F.lit(False).alias("planted"))
    b = pool(s, d).where("id % 50 = 7").select("id", F.lit(True).alias("planted"))
    clash = F.raise_error(F.lit("a record is both sampled and planted")).cast("boolean")
    both = a.unionByName(b).groupBy("id").agg(F.max("planted").alias("planted"), F.count("*").alias("_n"))
    return both.select("id", F.when(F.col("_n") > 1, clash).otherwise(F.col("planted")).alias("planted"), F.round(ordering.seeded(3, "id"), 9).alias("draw"))


def strata_of(s, d):
    return pool(s, d).select("id", F.concat_ws("|", F.coalesce("grp", F.lit("Unknown")), F.coalesce((F.col("user_id") % 3).cast("string"), F.lit("na"))).alias("stratum"))


def aligned(s, d):
    """A consensus below its reference becomes the reference; one above it settles nothing."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_type", " ").alias("path"), F.col("p_size").alias("k"))
    ref = F.slice("path", F.lit(1), F.col("k") % 3 + 1)
    con = F.when(F.col("k") % 7 == 0, F.array(F.lit("X"))).otherwise(F.slice("path", F.lit(1), F.col("k") % 2 + 1))
    x = p.select("id", con.alias("con"), ref.alias("ref"), F.lit(0.9).alias("posterior"))
    starts = lambda a, b: (F.size(a) > F.size(b)) & (F.slice(a, F.lit(1), F.size(b)) == F.col(b))
    return x.select("id", F.array_join(F.when(starts("con", "ref"), F.col("ref")).otherwise(F.col("con")), " ").alias("taxon"), F.when(starts("ref", "con"), 0.0).otherwise(F.col("posterior")).alias("posterior"))


def metaweb_pairs(s, d):
    """p of each asked pair of species: the highest of the known pairs whose names cover both, as the name itself or as its genus."""
    li = table(s, d, "lineitem")
    known = li.groupBy(F.concat(F.lit("g"), F.col("l_suppkey") % 10).alias("pred"), F.concat(F.lit("g"), F.col("l_partkey") % 10, F.lit(" s"), F.col("l_partkey") % 3).alias("prey")).agg(F.round(1 - 1 / F.count("*"), 6).alias("p"))
    asked = table(s, d, "orders").select(F.concat(F.lit("g"), F.col("o_custkey") % 12, F.lit(" s"), F.col("o_custkey") % 2).alias("a"), F.concat(F.lit("g"), F.col("o_orderkey") % 12, F.lit(" s"), F.col("o_orderkey") % 4).alias("b")).distinct()
    covers = lambda c: F.array(F.col(c), F.substring_index(c, " ", 1))
    x = asked.select("a", "b", F.explode(covers("a")).alias("pred"), covers("b").alias("bs")).select("a", "b", "pred", F.explode("bs").alias("prey"))
    return x.join(known, ["pred", "prey"]).groupBy("a", "b").agg(F.max("p").alias("p"))


def drift(s, d):
    """Pool and source totals, and whether their difference makes a reconciliation due."""
    mine = pool(s, d).where("id % 40 <> 0").agg(F.count("*").alias("mine"))
    both = mine.crossJoin(pool(s, d).agg(F.count("*").alias("theirs")))
    return both.withColumn("due", F.abs(F.col("mine") - F.col("theirs")) > 0.02 * F.col("theirs"))


def taxonomy_cover(s, d):
    p = table(s, d, "part").select(F.split("p_type", " ").alias("path"), (F.col("p_size") % 3 != 0).alias("complete"), F.col("p_brand").alias("brand"))
    hit = F.array_contains("path", "BRASS")
    return p.groupBy("brand").agg(F.count_if("complete").alias("complete"), F.count_if(~F.col("complete")).alias("incomplete"), F.count_if(hit).alias("match"), F.count_if(~hit & F.col("complete")).alias("other"), F.count_if(~hit & ~F.col("complete")).alias("unknown"))


def neighbour_rows(s, d):
    """A list of neighbour ids as places in the table, -1 where it has none."""
    r = rows(s, d).select("id", F.array(*[(F.col("id") * k + 1) % 2500 for k in (1, 3, 7)]).alias("nb"))
    own = rows(s, d).select(F.col("id").alias("nb"), F.col("id").alias("row"))
    x = r.select("id", F.posexplode("nb").alias("place", "nb")).join(own, "nb", "left")
    return x.select("id", "place", F.coalesce("row", F.lit(-1)).alias("row"))


def unordered(s, d):
    """Whether a pair is known in either order."""
    li = table(s, d, "lineitem")
    known = li.where("l_linenumber = 1").select(F.least("l_suppkey", F.col("l_partkey") % 100).alias("a"), F.greatest("l_suppkey", F.col("l_partkey") % 100).alias("b")).distinct().withColumn("known", F.lit(True))
    asked = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("x"), (F.col("o_orderkey") % 100).alias("y"))
    return asked.withColumn("a", F.least("x", "y")).withColumn("b", F.greatest("x", "y")).join(known, ["a", "b"], "left").select("id", F.coalesce("known", F.lit(False)).alias("known"))


def first_own(s, d):
    """Each record's earliest identification by its observer, and the bin of its age at the end of the table."""
    i = idents(s, d)
    own = i.where("user_id is not null and user_id = observer_id").groupBy("id").agg(F.min("created_at").alias("at"))
    x = own.crossJoin(F.broadcast(i.agg(F.max("created_at").alias("end"))))  # one row
    days = F.datediff("end", "at")
    return x.select("id", F.when(days <= 365, "year").when(days <= 730, "two").when(days <= 1460, "four").otherwise("older").alias("age"))


def binned(s, d):
    """Counts by the unit that suits the span of the table: day, week, month or year."""
    low, high = pool(s, d).agg(F.min("created_at"), F.max("created_at")).first()
    unit = next((u for u, most in (("day", 92), ("week", 732), ("month", 25 * 366)) if (high - low).days <= most), "year")
    return pool(s, d).groupBy(F.date_trunc(unit, "created_at").cast("date").alias("bin"), "grp").agg(F.count("*").alias("n"))


def project_rows(s, d):
    """Projects as rows: the ids of each, in order, as runs of ids and their places."""
    p = idents(s, d).select("answer", "id").distinct()
    return ordering.ranked(p, ["answer"], [F.col("id").asc()])


def key_print(s, d):
    return table(s, d, "region").select(F.col("r_regionkey").alias("id"), F.substring(F.sha2(F.concat(F.lit("key:"), F.col("r_name")), 256), 1, 12).alias("print"))


def letters(s, d):
    """Letters of lists in the order of their keyed digests."""
    n = table(s, d, "region").select(F.col("r_name").alias("arm"), hmac_sha256(KEY, F.col("r_name")).alias("_h"))
    return n.select("arm", F.substring(F.lit("ABCDEFGH"), F.row_number().over(Window.orderBy("_h")), F.lit(1)).alias("label"))  # one row a list


def names_of_taxa(s, d):
    """For each name in lower case and single spaces, the first common name that isn't empty."""
    p = table(s, d, "part").select(F.lower(F.trim(F.regexp_replace("p_name", r"\s+", " "))).alias("name"), F.when(F.col("p_size") % 3 != 0, F.trim("p_type")).alias("common"), "p_partkey")
    return p.groupBy("name").agg(F.min_by("common", F.when(F.col("common").isNotNull(), F.col("p_partkey"))).alias("common"))


def subjects(s, d):
    """The two subjects of "A eating B", field terms in plain words."""
    e = table(s, d, "events").select("event_id", F.concat("event_type", F.lit(" eating nymph "), F.col("user_id")).alias("text"))
    plain = F.regexp_replace("text", r"\bnymph\b", "young insect")
    return e.select("event_id", F.trim(F.get(F.split(plain, " eating "), F.lit(0))).alias("who"), F.trim(F.get(F.split(plain, " eating "), F.lit(1))).alias("what"))


def signals(s, d):
    """Cohesion of batches as text for a manifest: four decimals, null where there is none."""
    from fieldqueue.operators.vectors import cohesion

    c = cohesion(rows(s, d).withColumn("batch", F.floor(F.col("id") / 50)), "batch")
    return c.select("batch", F.to_json(F.struct(F.col("n").alias("n_embedded"), F.round("cohesion", 4).alias("cohesion")), {"ignoreNullFields": "false"}).alias("json")).select("batch", F.get_json_object("json", "$.n_embedded").cast("long").alias("n"), F.get_json_object("json", "$.cohesion").cast("double").alias("cohesion"))


def level_ranks(s, d, high=("mislabel", "taxonomist", "weird")):
    """A record's place among those of its level, 0 to show first: some levels by the lowest score, others by the highest."""
    x = scores(s, d).where("own is not null").select("id", F.when(F.col("margin") < 0, "mislabel").when(F.col("margin") < 0.05, "narrow").otherwise("easy").alias("level"), F.round("margin", 9).alias("score"))
    key = F.when(F.col("level").isin(*high), F.col("score")).otherwise(-F.col("score"))
    return ordering.ranked(x.withColumn("_k", key), ["level"], [F.col("_k").asc(), F.col("id").desc()], "place", "m").select("id", "level", "place", F.ceil(100 * (F.col("place") + 1) / F.col("m")).cast("int").alias("pct"))


def shares(s, d):
    n = idents(s, d).groupBy("rank").agg(F.count("*").alias("n"), F.count_if(F.col("answer") == "R").alias("k"))
    lo, hi = analysis.wilson(F.col("k"), F.col("n"))
    return n.select("rank", F.round(lo, 8).alias("lo"), F.round(hi, 8).alias("hi"), F.round(analysis.corrected_share(F.col("k") / F.col("n"), F.lit(0.05)), 8).alias("fixed"))


def near_cells(s, d):
    """Kilometres of the sphere between a place and its cell, by haversine, by chord, and on a plane."""
    p = geo.nearest_cell(places(s, d), cells(s, d), 60.0).where("cell is not null").select("id", "lat", "lon", "cell").join(cells(s, d).withColumnsRenamed({"lat": "clat", "lon": "clon"}), "cell")
    a, b = geo.unit_sphere(F.col("lat"), F.col("lon")), geo.unit_sphere(F.col("clat"), F.col("clon"))
    chord = F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0)))
    (ax, ay), (bx, by) = geo.plane_km(F.col("lat"), F.col("lon")), geo.plane_km(F.col("clat"), F.col("clon"))
    return p.select("id", F.round(geo.haversine(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")), 4).alias("great"), F.round(geo.chord_km(chord), 4).alias("by_chord"), F.round(F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)), 4).alias("plane"))


B = f"""b as ({BATCHES['build_batches']}), l as (select case arm when 'control' then 'A' when 'novelty' then 'B' else 'C' end "label", "group", regexp_extract(batch_id, '([^-]+)$', 1)::BIGINT batch_index, "position", id from b)"""
LEVELED = SCORES + """, lv as (select id, case when margin < 0 then 'mislabel' when margin < 0.05 then 'narrow' else 'easy' end "level", round(margin, 9) score from sc where own is not null),
    rk as (select id, "level", row_number() over (partition by "level" order by case when "level" in ('mislabel', 'taxonomist', 'weird') then score else -score end, id desc) - 1 place, count(*) over (partition by "level") m from lv)"""
#: Each query by its name, with the SQL that gives the same rows.
ENTRIES = {
    "scan_pool": (lambda s, d: tables.checked(pool(s, d), ["id", "grp", "created_at"]).select("id", "grp", "created_at"), f"with {POOL} select id, grp, created_at from pool"),
    "scan_frame": (lambda s, d: tables.framed(pool(s, d).select(*[F.col(c).cast("string") for c in ("id", "user_id", "grp")]), "id long, user_id long, grp string, note string").drop("note"), f"with {POOL} select id, user_id, grp from pool"),
    "src_count": (lambda s, d: pool(s, d).where("status = 'O'").agg(F.count("*").alias("n")), f"with {POOL} select count(*) n from pool where status = 'O'"),
    "src_jsonl": (lines, f"with {POOL} select id, grp from pool where created_at < timestamp '{DAY}'"),
    "src_csv_taxa": (taxa, "select p_partkey taxon_id, p_size * 10.0::DOUBLE rank_level from part"),
    "src_exports": (exports, f"with {IDENTS} select 'u' || user_id login, id record, arg_max(answer, (created_at, seq, answer)) answer from idents where user_id is not null group by 1, 2"),
    "src_store": (fallback, f"with {BASE} select id, case when \"label\" < 5 then 'store-' || \"label\" else 'store-*' end store from r"),
    "src_taxa_vec": (lambda s, d: rows(s, d).select("id", F.round(F.get("v", F.lit(0)).cast("double") / F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 6).alias("x")), f"with {BASE} select id, round(v[1] / sqrt(list_dot_product(v, v)), 6) x from r"),
    "src_globi": (lambda s, d: table(s, d, "lineitem").where("l_returnflag in ('A', 'R')").groupBy(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 50).alias("target")).agg(F.count("*").alias("n")).where("n >= 4"), "select l_suppkey source, l_partkey % 50 target, count(*) n from lineitem where l_returnflag in ('A', 'R') group by 1, 2 having count(*) >= 4"),
    "src_block_sample": (blocks, "with b as (select min(o_orderkey) lo, max(o_orderkey) hi from orders), st as (select block, lo + ('0x' || substr(md5('9:' || block), 1, 13))::BIGINT % (hi - lo) s from b, range(0, 5) t(block)) select block::INT block, o_orderkey id from orders join st on o_orderkey > s qualify row_number() over (partition by block order by o_orderkey) <= 200"),
    "sink_pairs": (lambda s, d: state.last_wins(table(s, d, "lineitem").select((F.col("l_suppkey") % 50).alias("a"), (F.col("l_partkey") % 50).alias("b"), F.col("l_linenumber").alias("file"), F.col("l_orderkey").alias("line"), "l_returnflag"), ["a", "b"], [F.col("file"), F.col("line"), F.col("l_returnflag")]).select("a", "b", "l_returnflag"), "select l_suppkey % 50 a, l_partkey % 50 b, arg_max(l_returnflag, (l_linenumber, l_orderkey, l_returnflag)) l_returnflag from lineitem group by 1, 2"),
    "half_open_window": (lambda s, d: half_open(idents(s, d), *WINDOW).select("id", "seq", "created_at", "answer"), f"with {IDENTS} select id, seq, created_at, answer from idents where created_at >= timestamp '{WINDOW[0]}' and created_at < timestamp '{WINDOW[1]}'"),
    "species_rank": (lambda s, d: idents(s, d).where(F.col("rank").isin(RANKS[:2])).groupBy("rank").agg(F.count("*").alias("n")), f"with {IDENTS} select rank, count(*) n from idents where rank in ('species', 'genus') group by 1"),
    "filter_acc": (accuracy, f"with {POOL}, a as (select id, case when id % 7 <> 0 then user_id % 2000 end m, id % 5 = 0 obscured from pool) select id, case when m is null then 'unknown' when m <= 10 then '10 m' when m <= 100 then '100 m' when m <= 1000 then '1 km' else 'known' end \"class\", m is not null and not obscured shown from a"),
    "filter_range": (range_filter, "select c_custkey id, c_custkey * 17 % 120 >= 50 far, c_custkey % 10 in (c_custkey * 3 % 10, c_custkey * 7 % 10) fits from customer"),
    "filter_taxa_live": (live, "with p as (select string_split(p_type, ' ') path, p_size % 4 st from part) select case when list_contains(path, 'TIN') then 'excluded' when not list_has_any(path, ['STANDARD', 'SMALL', 'LARGE']) then 'not asked for' when st = 0 then 'missing' when st = 1 then 'not open' else 'kept' end why, count(*) n from p group by 1"),
    "scope": (scope, "select p_partkey id, case when list_has_any(string_split(p_type, ' '), ['STANDARD', 'BRASS']) then true when p_size % 3 <> 0 then false end member from part"),
    "nibble": (lambda s, d: idents(s, d).groupBy("id").agg(F.count("*").alias("n")).select("id", facets.nibble(F.col("n") * 3 - 4).alias("nibble")), f"with {IDENTS} select id, least(greatest(count(*) * 3 - 4, 0), 15)::INT nibble from idents group by 1"),
    "observer_users": (lambda s, d: idents(s, d).select("id", "seq", F.when(F.col("user_id").between(1, 2**32 - 1), F.col("user_id")).otherwise(0).alias("user_id")), f"with {IDENTS} select id, seq, coalesce(user_id, 0) user_id from idents"),
    "identify_url": (batch_urls, f"with {B} select batch_id, 'https://example.org/review?id=' || string_agg(id::VARCHAR, ',' order by id) url from b group by 1"),
    "photo_alt": (lambda s, d: table(s, d, "pages").select("page_id", F.regexp_replace("url", "^https?://[^/]+", "https://mirror.example.org").alias("url")), "select page_id, regexp_replace(url, '^https?://[^/]+', 'https://mirror.example.org') url from pages"),
    "join_lookup_left": (lambda s, d: idents(s, d).select("id", "seq", "answer").join(state.first_wins(served(s, d).select("id", "arm", "position"), ["id"], [F.col("position")]).select("id", "arm"), "id", "left"), f"with {IDENTS}, {SERVED} select idents.id, seq, answer, arm from idents left join served using (id)"),
    "join_left_outcomes": (lambda s, d: served(s, d).select("id", "arm").join(pool(s, d).select("id", "status"), "id", "left").join(idents(s, d).groupBy("id").agg(F.count("*").alias("n")), "id", "left"), f"with {POOL}, {IDENTS}, {SERVED}, n as (select id, count(*) n from idents group by 1) select served.id, arm, status, n from served left join pool using (id) left join n using (id)"),
    "join_semi": (lambda s, d: state.drop_closed(pool(s, d), pool(s, d).where("id % 2 = 0"), idents(s, d).where("answer = 'A'")).select("id"), f"with {POOL}, {IDENTS} select id from pool where id % 2 <> 0 or id in (select id from idents where answer = 'A')"),
    "join_inner_composite": (lambda s, d: pool(s, d).select("id", "grp", "status").join(pool(s, d).where("id % 3 <> 0").select("id", F.when(F.col("id") % 5 == 0, "moved").otherwise(F.col("grp")).alias("grp"), (F.col("id") * 2).alias("v")), ["id", "grp"]), f"with {POOL} select id, grp, status, id * 2 v from pool where id % 3 <> 0 and id % 5 <> 0"),
    "join_align_pair": (lambda s, d: pool(s, d).select("id", "grp").join(pool(s, d).where("id % 3 <> 0").select("id", F.when(F.col("id") % 5 == 0, "moved").otherwise(F.col("grp")).alias("grp"), F.lit(True).alias("found")), ["id", "grp"], "left").select("id", F.coalesce("found", F.lit(False)).alias("found")), f"with {POOL} select id, id % 3 <> 0 and id % 5 <> 0 found from pool"),
    "join_align_vec": (lambda s, d: pool(s, d).select("id").join(rows(s, d).select("id", "label"), "id", "left").groupBy(F.col("label").isNotNull().alias("embedded")).agg(F.count("*").alias("n"), F.sum("label").alias("labels")), f"with {POOL}, {BASE} select \"label\" is not null embedded, count(*) n, sum(\"label\")::BIGINT labels from pool left join r using (id) group by 1"),
    "join_score": (lambda s, d: geo.nearest_cell(places(s, d), cells(s, d), 60.0).select("id", F.when(F.col("cell").isNotNull(), F.col("cell") % 7 / 7).alias("score")).groupBy(F.round("score", 6).alias("score")).agg(F.count("*").alias("n")), f"with {NEAR} select round(cell % 7 / 7, 6) score, count(*) n from near group by 1"),
    "join_range": (lambda s, d: state.range_counts(pool(s, d).where("id % 97 <> 0"), pool(s, d), 100), f"with {POOL} select id // 100 * 100 low, count(*) filter (id % 97 <> 0) mine, count(*) theirs from pool group by 1 having count(*) <> count(*) filter (id % 97 <> 0)"),
    "join_neighbors": (neighbour_rows, f"with {BASE}, x as (select id, unnest([0, 1, 2]) place, unnest([(id + 1) % 2500, (id * 3 + 1) % 2500, (id * 7 + 1) % 2500]) nb from r) select x.id, place, coalesce(r.id, -1) \"row\" from x left join r on r.id = nb"),
    "join_pairs_unordered": (unordered, "with k as (select distinct least(l_suppkey, l_partkey % 100) a, greatest(l_suppkey, l_partkey % 100) b from lineitem where l_linenumber = 1) select o_orderkey id, k.a is not null known from orders left join k on k.a = least(o_custkey % 100, o_orderkey % 100) and k.b = greatest(o_custkey % 100, o_orderkey % 100)"),
    "agg_first_nonnull": (lambda s, d: idents(s, d).groupBy("id").agg(F.min_by("user_id", F.when(F.col("user_id").isNotNull(), F.struct("created_at", "seq", "user_id"))).alias("user_id")), f"with {IDENTS} select id, arg_min(user_id, (created_at, seq, user_id)) filter (user_id is not null) user_id from idents group by 1"),
    "identifier_counts": (lambda s, d: analysis.by_arm(pairs(s, d).where("user_id % 2 = 0"), served(s, d).select("id", "arm"), ARMS), f"with {IDENTS}, {SERVED}, {PAIRS} select user_id, {COLS} from pairs join served using (id) where user_id % 2 = 0 group by 1"),
    "signals_json": (signals, f"with {BASE}, u as (select id // 50 batch, list_transform(v, lambda y: y / sqrt(list_dot_product(v, v))) u from r), e as (select batch, unnest(u) x, unnest(range(0, len(u))) i from u), t as (select batch, i, sum(x) s, count(*) n from e group by 1, 2) select batch, max(n) n, round(sqrt(sum(s * s)) / max(n), 4) cohesion from t group by 1"),
    "pool_counts": (drift, f"with {POOL}, m as (select count(*) filter (id % 40 <> 0) mine, count(*) theirs from pool) select *, abs(mine - theirs) > 0.02 * theirs due from m"),
    "coverage_taxonomy": (taxonomy_cover, "select p_brand brand, count(*) filter (p_size % 3 <> 0) complete, count(*) filter (p_size % 3 = 0) incomplete, count(*) filter (p_type like '%BRASS%') \"match\", count(*) filter (p_type not like '%BRASS%' and p_size % 3 <> 0) other, count(*) filter (p_type not like '%BRASS%' and p_size % 3 = 0) \"unknown\" from part group by 1"),
    "win_rank_level": (lambda s, d: level_ranks(s, d).select("id", "level", "place"), f"with {LEVELED} select id, \"level\", place from rk"),
    "win_pct_ceil": (lambda s, d: level_ranks(s, d).select("id", "pct"), f"with {LEVELED} select id, ceil(100 * (place + 1) / m)::INT pct from rk"),
    "win_perspecies": (per_species, f"with {POOL}, {IDENTS}, p as (select id, grp, max(answer) answer from idents join pool using (id) where seq = 1 group by 1, 2) select * from p qualify row_number() over (partition by grp, answer order by id desc) <= 3"),
    "win_vec_last": (lambda s, d: state.last_wins(parts_of_index(s, d), ["id"], [F.col("part")]).select("id", F.round("x", 6).alias("x")), f"with {BASE} select id, case when id % 2 = 0 then round(round(v[1]::DOUBLE, 6) + 1, 6) else round(v[1]::DOUBLE, 6) end x from r where id % 3 <> 0 or id % 2 = 0"),
    "index_append": (index_appended, f"with {BASE} select case when id % 3 <> 0 then 'a' else 'c' end part, count(*) n, sum(id)::BIGINT ids from r group by 1"),
    "index_compact": (lambda s, d: state.compact(parts_of_index(s, d), rows(s, d).where("id % 5 <> 0")).select("id", "part", F.round("x", 6).alias("x")), f"with {BASE} select id, 'base' part, case when id % 2 = 0 then round(round(v[1]::DOUBLE, 6) + 1, 6) else round(v[1]::DOUBLE, 6) end x from r where (id % 3 <> 0 or id % 2 = 0) and id % 5 <> 0"),
    "order_gap_first": (lambda s, d: ordering.ranked(pool(s, d), ["grp"], ordering.by_score("score")).where("score is null").select("id", "place"), f"with {POOL}, r as (select id, score, row_number() over (partition by grp order by score desc nulls last, created_at desc, id desc) - 1 place from pool) select id, place from r where score is null"),
    "order_bt": (lambda s, d: ordering.ranked(queue(s, d).withColumn("k", F.lit(1)), ["k"], [F.col("s").desc_nulls_last(), F.col("created_at").desc(), F.col("id").asc()]).select("id", "place"), f"with {POOL} select id, row_number() over (order by score desc nulls last, created_at desc, id) - 1 place from pool"),
    "order_valid": (lambda s, d: ordering.ranked(pool(s, d), ["grp"], ordering.recency(), "place", "m").groupBy("grp").agg((F.count_distinct("place") == F.max("m")).alias("valid"), F.min("place").alias("low"), F.max("place").alias("high")), f"with {POOL} select grp, true valid, 0::BIGINT low, count(*) - 1 high from pool group by 1"),
    "bt_outcomes": (lambda s, d: queue(s, d).select("id", *[c.alias(n) for n, c in outcome_columns(queue(s, d)).items()]), f"""with {POOL}, q as (select id, case when id % 3 <> 0 then user_id % 90 end "days", status, (['same', 'corrected', 'coarsened', 'refined', 'none'])[id % 5 + 1] rel from pool)
        select id, coalesce("days" <= 30, false)::DOUBLE fast, coalesce("days" > 30, false)::DOUBLE slow, (status <> 'F')::DOUBLE stuck, (rel = 'corrected')::DOUBLE corrected, (rel = 'coarsened')::DOUBLE coarsened, (rel in ('corrected', 'coarsened'))::DOUBLE misid, (rel = 'refined')::DOUBLE refined from q"""),
    "cut_batches": (lambda s, d: ordering.ranked(pool(s, d), ["grp"], [F.col("id").asc()], "_p").select("id", F.floor(F.col("_p") / 50).alias("batch"), (F.col("_p") % 50).alias("position")), f"with {POOL}, r as (select id, row_number() over (partition by grp order by id) - 1 p from pool) select id, p // 50 batch, p % 50 \"position\" from r"),
    "topk_plan": (wanted, f"with {POOL}, {BASE}, m as (select * from pool where id not in (select id from r)), n as (select id from m where id % 11 <> 0 order by created_at, id limit 500) select 'planned' what, count(*) n, sum(id)::BIGINT ids from n union all select 'no photo', count(*), sum(id)::BIGINT from m where id % 11 = 0"),
    "sample_mix": (mixed, f"with {POOL} select id, id % 50 = 7 planted, round(('0x' || substr(md5('3:' || id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE, 9) draw from pool where id % 20 = 0 or id % 50 = 7"),
    "sample_kind": (lambda s, d: ordering.sample_strata(queue(s, d), ["relation", "grade"], 15, 21).select("id", "relation", "grade"), f"with {POOL}, q as (select id, (['same', 'corrected', 'coarsened', 'refined', 'none'])[id % 5 + 1] relation, case when status = 'F' then 'research' else 'needs_id' end grade from pool) select * from q qualify row_number() over (partition by relation, grade order by ('0x' || substr(md5('21:' || id), 1, 13))::BIGINT, id) <= 15"),
    "union_all": (lambda s, d: pool(s, d).select("id", "grp").unionByName(idents(s, d).select("id", "answer"), allowMissingColumns=True), f"with {POOL}, {IDENTS} select id, grp, null answer from pool union all select id, null, answer from idents"),
    "cdc_pull": (sided, f"with {POOL}, f as (select case when status in ('O', 'P') then 'kept' else 'gone' end side, created_at from pool where created_at > timestamp '{DAY}') select side, count(*) n, (select max(created_at) from f) newest from f group by 1"),
    "served_append": (appended, f"with {B}, d as (select '2026-01-01' build_date, \"label\", id from l union all select '2026-01-02', \"label\", id from l where id % 3 = 0) select build_date, \"label\", count(*) n, sum(id)::BIGINT ids from d group by 1, 2"),
    "sink_served": (lambda s, d: day_log(s, d).groupBy("build_date", "label", "group").agg(F.count("*").alias("n"), F.max("batch_index").alias("last")), f"with {B} select build_date, \"label\", \"group\", count(*) n, max(batch_index) \"last\" from l, (values ('2026-01-01'), ('2026-01-02')) t(build_date) group by 1, 2, 3"),
    "replay": (replayed, f"with {B} select 'expected' side, count(*) n, sum(id)::BIGINT ids from b where id % 41 <> 3 and id % 40 = 7 union all select 'rebuilt', count(*), sum(id)::BIGINT from b where id % 41 = 3 or id % 40 = 7"),
    "sink_study": (study, f"with {B} select \"label\", \"group\", batch_index, string_agg(id::VARCHAR, ',' order by \"position\") ids from l group by 1, 2, 3"),
    "align_consensus": (aligned, "with p as (select p_partkey id, string_split(p_type, ' ') path, p_size k from part), x as (select id, case when k % 7 = 0 then ['X'] else path[1:k % 2 + 1] end con, path[1:k % 3 + 1] ref from p) select id, array_to_string(case when len(con) > len(ref) and con[1:len(ref)] = ref then ref else con end, ' ') taxon, case when len(ref) > len(con) and ref[1:len(con)] = con then 0 else 0.9 end::DOUBLE posterior from x"),
    "ranks_notes": (lambda s, d: pool(s, d).select("id", "grp").join(pool(s, d).where("id % 3 = 0").select("id", F.concat(F.lit("note "), "id").alias("note")), "id", "left").select("id", F.when(F.col("grp") == "2-HIGH", F.col("note")).alias("note")), f"with {POOL} select id, case when grp = '2-HIGH' and id % 3 = 0 then 'note ' || id end note from pool"),
    "key_fp": (key_print, "select r_regionkey id, substr(sha256('key:' || r_name), 1, 12) print from region"),
    "labels_keyed": (letters, f"select r_name arm, substr('ABCDEFGH', (row_number() over (order by {hmac_sql('r_name')}))::INT, 1) \"label\" from region"),
    "stratified_deal": (lambda s, d: batches.deal_stratified(strata_of(s, d), ARMS, 4), f"with {POOL}, st as (select id, grp || '|' || (user_id % 3) stratum from pool), n as (select stratum, row_number() over (order by stratum) - 1 start from (select distinct stratum from st)), r as (select id, stratum, start, row_number() over (partition by stratum order by md5('4:' || stratum || ':' || id), id) - 1 at_ from st join n using (stratum)) select id, (['control', 'novelty', 'recency'])[((start + at_) % 3 + 1)::INT] arm, stratum from r"),
    "geo_xyz": (lambda s, d: places(s, d).select("id", *[F.round(x, 9).alias(n) for n, x in zip("xyz", geo.unit_sphere(F.col("lat"), F.col("lon")))]), f"with p as (select c_custkey id, {AT.format(k='c_custkey', a=7, b=13)} from customer) select id, round(cos(radians(lat)) * cos(radians(lon)), 9) x, round(cos(radians(lat)) * sin(radians(lon)), 9) y, round(sin(radians(lat)), 9) z from p"),
    "geo_chord": (lambda s, d: near_cells(s, d).select("id", "by_chord"), f"with {NEAR}, q as (select near.id, p.lat a, p.lon o, c.lat ca, c.lon co from near join p using (id) join c using (cell)), h as (select id, sqrt(pow(cos(radians(a)) * cos(radians(o)) - cos(radians(ca)) * cos(radians(co)), 2) + pow(cos(radians(a)) * sin(radians(o)) - cos(radians(ca)) * sin(radians(co)), 2) + pow(sin(radians(a)) - sin(radians(ca)), 2)) ch from q) select id, round(2 * 6371.0088 * asin(least(ch / 2, 1)), 4) by_chord from h"),
    "geo_haversine": (lambda s, d: near_cells(s, d).select("id", "great"), f"with {NEAR} select id, round(km, 4) great from near where cell is not null"),
    "geo_equirect": (lambda s, d: places(s, d).select("id", *[F.round(x, 6).alias(n) for n, x in zip("xy", geo.plane_km(F.col("lat"), F.col("lon")))]), f"with p as (select c_custkey id, {AT.format(k='c_custkey', a=7, b=13)} from customer) select id, round(lon * 111.32::DOUBLE * cos(radians(54)), 6) x, round(lat * 110.57::DOUBLE, 6) y from p"),
    "dates": (lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("bad").alias("t")).select("id", F.to_date(F.try_to_timestamp("t")).alias("day")), "select o_orderkey id, case when o_orderkey % 3 < 2 then o_orderdate::DATE end \"day\" from orders"),
    "hist_start": (lambda s, d: pool(s, d).agg(F.trunc(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.percentile(F.datediff("created_at", F.lit("1970-01-01").cast("date")), F.lit(0.005))).cast("int")), "YEAR").alias("start")), f"with {POOL} select date_trunc('year', date '1970-01-01' + floor(quantile_cont(date_diff('day', date '1970-01-01', created_at::DATE), 0.005))::INT)::DATE start from pool"),
    "utc": (lambda s, d: table(s, d, "events").select("event_id", F.date_format(F.to_utc_timestamp("ts", "America/Vancouver"), "yyyy-MM-dd HH:mm").alias("utc")), "select event_id, strftime((ts at time zone 'America/Vancouver') at time zone 'UTC', '%Y-%m-%d %H:%M') utc from events"),
    "wilson": (lambda s, d: shares(s, d).select("rank", "lo", "hi"), f"with {IDENTS}, g as (select rank, count(*) n, count(*) filter (answer = 'R') / count(*) p, 1.959963984540054::DOUBLE z from idents group by 1) select rank, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 8) lo, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 8) hi from g"),
    "correct": (lambda s, d: shares(s, d).select("rank", "fixed"), f"with {IDENTS} select rank, round(least(greatest((count(*) filter (answer = 'R') / count(*) - 0.05::DOUBLE) / 0.9::DOUBLE, 0), 1), 8) fixed from idents group by 1"),
    "two_words": (lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.size(F.split(F.trim("p_name"), r"\s+")) == 2).alias("two")), r"select p_partkey id, len(string_split_regex(trim(p_name), '\s+')) = 2 two from part"),
    "norm_names": (names_of_taxa, r"select lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))) name, arg_min(case when p_size % 3 <> 0 then trim(p_type) end, p_partkey) filter (p_size % 3 <> 0) common from part group by 1"),
    "text_subjects": (subjects, "select event_id, event_type who, 'young insect ' || user_id what from events"),
    "metaweb_lookup": (metaweb_pairs, "with k as (select 'g' || (l_suppkey % 10) pred, 'g' || (l_partkey % 10) || ' s' || (l_partkey % 3) prey, round(1 - 1 / count(*), 6) p from lineitem group by 1, 2), a as (select distinct 'g' || (o_custkey % 12) || ' s' || (o_custkey % 2) a, 'g' || (o_orderkey % 12) || ' s' || (o_orderkey % 4) b from orders) select a, b, max(p) p from a join k on pred in (a, split_part(a, ' ', 1)) and prey in (b, split_part(b, ' ', 1)) group by 1, 2"),
    "json_props": (lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")), "select event_id, props::JSON->>'k' k from events"),
    "first_own": (first_own, f"with {IDENTS}, f as (select id, date_diff('day', min(created_at)::DATE, (select max(created_at) from idents)::DATE) a from idents where user_id = observer_id group by 1) select id, case when a <= 365 then 'year' when a <= 730 then 'two' when a <= 1460 then 'four' else 'older' end age from f"),
    "hist_bins": (binned, f"with {POOL} select date_trunc('month', created_at)::DATE bin, grp, count(*) n from pool group by 1, 2"),
    "sink_projects": (project_rows, f"with {IDENTS}, x as (select distinct answer, id from idents) select answer, id, row_number() over (partition by answer order by id) - 1 place from x"),
}
QUERIES = {name: f for name, (f, _) in ENTRIES.items()}
ORACLE = {name: sql for name, (_, sql) in ENTRIES.items() if sql}
