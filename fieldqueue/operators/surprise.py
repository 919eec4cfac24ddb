"""Surprise of a record's name at its place, against reference points, and priors by rank."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldqueue.operators.geo import plane_km
from fieldqueue.operators.ordering import same, summed_before
from fieldqueue.sources.shared import kept

#: Cells along a tile's side; points that one task holds against a tile's cells at a time.
TILE, POINTS = 8, 50_000
# fixed values: rank levels; least reference points of a name; start and least rows of a prior; kilometres that a reference may be off
SPECIES, GENUS, FAMILY, ORDER = 10, 20, 30, 40
LEAST_REF, PRIOR_START, PRIOR_LEAST, MOST_OFF = 5, "2018-01-01", 30, 2.0


def extent(error: float) -> tuple[int, int]:
    """Cells to look at on each side, and powers to keep, so that a kernel of height 1 is met within `error`.

    Half of the error is left to kernels beyond the cells, the other half to the two dimensions' missing powers.
    """
    reach = math.ceil(math.sqrt(2 * math.log(2 / error)))
    t = np.linspace(0, reach + 1, 4001)[1:]
    term = lambda n: float(np.exp(-t * t / 2 + n * np.log(t / 2) - math.lgamma(n + 1)).max())
    terms = 1
    while 2 * sum(term(n) for n in range(terms, terms + 60)) > error / 2:
        terms += 1
    return reach, terms


def densities(ref: DataFrame, asked: DataFrame, h: float, error: float = 1e-6) -> DataFrame:
    """The rows of `asked` (key, id, x, y, ...) with `density`: the sum over the key's points of ref (key, x, y) of exp(-distance**2 / 2 h**2), each within `error`; 0 for a key without points, null where x or y is.

    Points meet as sums: those in a cell of side h become the moments of their kernels about its middle, which are added up
    in tasks before the shuffle. Tiles of TILE x TILE cells carry the moments of the cells in and around them; a tile's
    queries are read in parts of about POINTS, each beside the tile's moments, so that neither a hot key nor a
    crowded cell makes pairs or a large task. Cells are left out only where their kernels lie below the error.
    """
    reach, terms = extent(error)
    cells = lambda c: F.floor(F.col(c) / h)
    fine = lambda d: d.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    r = fine(ref.select("key", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).withColumn("gx", cells("x")).withColumn("gy", cells("y"))
    off = lambda c, g: F.col(c) / h - F.col(g) - 0.5
    r = r.withColumn("_u", off("x", "gx")).withColumn("_v", off("y", "gy")).withColumn("_e", F.exp(-(F.col("_u") * F.col("_u") + F.col("_v") * F.col("_v")) / 2))
    powers = r.select("key", "gx", "gy", *[(F.col("_e") * F.pow("_u", F.lit(a)) / math.factorial(a)).alias(f"_u{a}") for a in range(terms)], *[(F.pow("_v", F.lit(b)) / math.factorial(b)).alias(f"_v{b}") for b in range(terms)])
    sums = [F.sum(F.col(f"_u{a}") * F.col(f"_v{b}")) for a in range(terms) for b in range(terms)]
    moments = powers.groupBy("key", "gx", "gy").agg(F.array(*sums).alias("m"))
    low = lambda c: F.floor((F.col(c) - reach) / TILE)
    high = lambda c: F.floor((F.col(c) + reach) / TILE)
    around = moments.withColumn("tx", F.explode(F.sequence(low("gx"), high("gx")))).withColumn("ty", F.explode(F.sequence(low("gy"), high("gy"))))
    names, plain = asked.columns, asked.select("*", cells("x").alias("_gx"), cells("y").alias("_gy"))
    q = fine(plain).withColumn("tx", F.floor(F.col("_gx") / TILE)).withColumn("ty", F.floor(F.col("_gy") / TILE))
    tile = ["key", "tx", "ty"]
    shares = q.groupBy(*tile).agg(F.ceil(F.count("*") / POINTS).cast("int").alias("_shares"))
    on = lambda a, b: same(a, b, tile)
    q = q.alias("a").join(shares.alias("b"), on("a", "b")).select("a.*", F.pmod(F.xxhash64("id"), F.col("_shares")).cast("int").alias("_share"))
    held = around.alias("a").join(shares.alias("b"), on("a", "b")).select(*[F.col(f"a.{c}").alias(f"_{c}") for c in tile], "gx", "gy", "m", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_part"))
    schema = ", ".join(f"`{c}` {t}" for c, t in asked.dtypes) + ", density double"

    def met(points: pa.Table, sums: pa.Table) -> pa.Table:
        x, y = (points.column(c).to_numpy().astype(float) / h for c in ("x", "y"))
        total = np.zeros(len(x))
        gx, gy = sums.column("gx").to_pylist(), sums.column("gy").to_pylist()
        for i, (cx, cy) in enumerate(zip(gx, gy)):
            u, v = x - cx - 0.5, y - cy - 0.5
            near = np.flatnonzero((np.abs(u) <= reach + 0.5) & (np.abs(v) <= reach + 0.5))
            if len(near):
                u, v = u[near], v[near]
                m = np.asarray(sums.column("m")[i].values).reshape(terms, terms)
                # the division of the moments' powers by factorials makes up the exponential's series
                total[near] += np.exp(-(u * u + v * v) / 2) * np.polynomial.polynomial.polyval2d(u, v, m)
        return pa.Table.from_arrays([*(points.column(c) for c in names), pa.array(total)], [*names, "density"])

    found = q.groupBy(*tile, "_share").cogroup(held.groupBy(*[f"_{c}" for c in tile], "_part")).applyInArrow(met, schema)
    rest = asked.where("x is null or y is null or isnan(x) or isnan(y)").withColumn("density", F.lit(None).cast("double"))
    return found.unionByName(rest)


def tail(ref: DataFrame, asked: DataFrame, h: float, least: int = LEAST_REF, error: float = 1e-6) -> DataFrame:
    """(key, id, tail, n) of queries (key, id, x, y): the share of the key's n reference points (key, id, x, y) whose density among the others beats the query's, and n.

    A reference point's density leaves itself out and is scaled by n / (n - 1). 1 where a key has fewer than
    `least` points, null where a query has no place. Every point counts, without a sample; places among
    densities come from sums by range, so that no key's points meet in one task. Densities that differ by less than
    2 n `error` may stand in either order.
    """
    r = kept(ref.where("key is not null and x is not null and y is not null and not isnan(x) and not isnan(y)").select("key", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    a = kept(asked.where("key is not null").select("key", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    n = r.groupBy("key").agg(F.count("*").alias("n"))
    both = kept(densities(r, r.select("key", "id", "x", "y", F.lit(1).alias("ref")).unionByName(a.withColumn("ref", F.lit(0))), h, error))
    both = both.join(n, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = (F.col("density") - 1) * F.col("n") / F.greatest(F.col("n") - 1, F.lit(1))
    both = both.withColumn("d", F.round(F.when(F.col("ref") == 1, own).otherwise(F.col("density")), 9))
    # at equal densities queries come first: only points that beat them lie before
    placed = summed_before(both, ["key"], [F.col("d").desc_nulls_last(), F.col("ref").asc()], "ref", "above")
    share = F.when(F.col("n") < least, 1.0).when(F.col("d").isNotNull(), F.col("above") / F.col("n"))
    return placed.where("ref = 0").select("key", "id", share.alias("tail"), "n")


def ranks(taxa: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """(taxon_id, one column a wanted rank): the nearest of a taxon and its ancestors with the rank's level, null without one. Rows (taxon_id, rank_level, ancestry: ids from the root, or null)."""
    line = F.concat(F.coalesce("ancestry", F.array().cast("array<bigint>")), F.array(F.col("taxon_id").cast("long")))
    steps = taxa.select("taxon_id", F.posexplode(line).alias("depth", "above"))
    levels = taxa.select(F.col("taxon_id").cast("long").alias("above"), F.col("rank_level").cast("double").alias("level"))
    at = lambda level: F.max_by("above", F.when(F.col("level") == level, F.col("depth")))
    return steps.join(levels, "above").groupBy("taxon_id").agg(*[at(v).alias(k) for k, v in wanted.items()])


def geo_surprise(pool: DataFrame, refs: DataFrame, taxa: DataFrame, before: str, h: float = 25.0, error: float = 1e-6) -> DataFrame:
    """(id, surprise, n_ref) of each record (id, lat, lon, taxon_id): how much of its name's cloud of references is denser than where it lies.

    The key is the record's species, or its genus where its name stands above species. References (latitude, longitude,
    positional_accuracy, taxon_id, quality_grade, observed_on) count if they are of research grade, from before `before`,
    and not known to be off by more than MOST_OFF kilometres; each counts for its species and for its
    genus. surprise is null without key or place; n_ref is 0 for a key without references, null without key.
    """
    rank = kept(ranks(taxa, {"species": SPECIES, "genus": GENUS}))
    key = F.coalesce("species", "genus")
    x, y = plane_km(F.col("lat"), F.col("lon"))
    p = kept(pool.select("id", "lat", "lon", "taxon_id").join(rank, "taxon_id", "left").select("id", key.alias("key"), x.alias("x"), y.alias("y")))
    good = refs.where((F.col("quality_grade") == "research") & (F.col("observed_on") < F.lit(before)) & (F.col("positional_accuracy").isNull() | (F.col("positional_accuracy") <= MOST_OFF * 1000)))
    rx, ry = plane_km(F.col("latitude"), F.col("longitude"))
    r = good.join(rank, "taxon_id").select(rx.alias("x"), ry.alias("y"), F.explode(F.array_distinct(F.array_compact(F.array("species", "genus")))).alias("key"))
    r = r.join(p.select("key").where("key is not null").distinct(), "key", "left_semi").withColumn("id", F.lit(0).cast("long"))
    found = tail(r.withColumn("id", F.monotonically_increasing_id()), p, h, error=error)
    return p.select("id").join(found.select("id", "tail", "n"), "id", "left").select("id", F.col("tail").alias("surprise"), F.col("n").alias("n_ref"))


def prior_chain(pool: DataFrame, refs: DataFrame, taxa: DataFrame, before: str, start: str = PRIOR_START, least: int = PRIOR_LEAST) -> DataFrame:
    """(id, prior, prior_rank): the share of research grade among a record's genus, else its family, else its order, whichever first has `least` references; null if none has.

    References count if they are of research grade or need identification, lie in the pool's own box and were observed from
    `start` to before `before`. Rows as for geo_surprise.
    """
    rank = kept(ranks(taxa, {"genus": GENUS, "family": FAMILY, "order": ORDER}))
    box = pool.agg(*[f(c).alias(f"{c}_{n}") for c in ("lat", "lon") for n, f in (("low", F.min), ("high", F.max))]).first()
    r = refs.where(F.col("quality_grade").isin("research", "needs_id") & F.col("latitude").between(box["lat_low"], box["lat_high"]) & F.col("longitude").between(box["lon_low"], box["lon_high"]))
    r = r.where((F.col("observed_on") >= F.lit(start)) & (F.col("observed_on") < F.lit(before))).join(rank, "taxon_id")
    names = ("genus", "family", "order")
    r = kept(r.groupBy(*names).agg(F.count("*").alias("n"), F.count_if(F.col("quality_grade") == "research").alias("good")))
    out = pool.select("id", "taxon_id").join(rank, "taxon_id", "left")
    for name in names:
        share = r.where(F.col(name).isNotNull()).groupBy(name).agg((F.sum("good") / F.sum("n")).alias(f"_{name}"), F.sum("n").alias("_n")).where(F.col("_n") >= least).drop("_n")
        out = out.join(share, name, "left")
    which = F.when(F.col("_genus").isNotNull(), "genus").when(F.col("_family").isNotNull(), "family").when(F.col("_order").isNotNull(), "order")
    return out.select("id", F.coalesce("_genus", "_family", "_order").alias("prior"), which.alias("prior_rank"))


def with_prior(surprise: DataFrame, priors: DataFrame, skip_below: float) -> DataFrame:
    """The surprise (id, surprise, ...) with prior and `skip`; a record whose prior is below skip_below has no surprise, one without prior keeps its own."""
    skip = F.coalesce(F.col("prior") < skip_below, F.lit(False))
    out = surprise.join(priors.select("id", "prior"), "id", "left").withColumn("skip", skip)
    return out.withColumn("surprise", F.when(~F.col("skip"), F.col("surprise")))
