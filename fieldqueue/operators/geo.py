"""Distances on the globe and the nearest cell of a grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS_KM = 6371.0088


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def nearest_cell(points: DataFrame, cells: DataFrame, max_km: float) -> DataFrame:
    """points with `cell` and `km` of the nearest cell within max_km, else null; ties to the smaller cell.

    Places lie in cubes on the unit sphere whose edge is the straight distance of max_km, so that a neighbouring cube is the
    farthest that can matter, and meet in an equi-join on the cube. Equal points are looked up once, and of cells at one place only the smallest is kept.
    """
    edge = 2 * math.sin(min(max_km / (2 * RADIUS_KM), math.pi / 2)) * (1 + 1e-9) + 1e-12
    cube = lambda lat, lon: [F.floor((p + 1) / edge) for p in unit_sphere(F.col(lat), F.col(lon))]
    c = cells.where("lat is not null and lon is not null").groupBy(F.col("lat").alias("clat"), F.col("lon").alias("clon")).agg(F.min("cell").alias("cell"))
    one = points.select("lat", "lon").where("lat is not null and lon is not null").distinct()
    for name, own, other in zip(("_cx", "_cy", "_cz"), cube("lat", "lon"), cube("clat", "clon")):
        one, c = one.withColumn(name, own), c.withColumn(name, F.explode(F.array(other - 1, other, other + 1)))
    km = haversine(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    near = one.join(c, ["_cx", "_cy", "_cz"]).withColumn("_km", km).where(F.col("_km") <= max_km)
    best = near.groupBy("lat", "lon").agg(F.min(F.struct("_km", "cell")).alias("b"))
    return points.join(best, ["lat", "lon"], "left").select(*points.columns, F.col("b.cell").alias("cell"), F.col("b._km").alias("km"))


def unit_code(km: Column) -> Column:
    """A distance as a byte: quarter kilometres up to 16, whole ones up to 100, then fives, 255 beyond."""
    half_up = lambda x: F.floor(x + 0.5)
    return F.when(km < 16, half_up(km * 4)).when(km < 100, half_up(km - 16) + 64).when(km < 600, half_up((km - 100) / 5) + 148).otherwise(255).cast("int")


def quantised(x: Column, low: Column, high: Column) -> Column:
    """Place between two bounds in 65535 steps, half to even; equal bounds give 0."""
    return F.rint((x - low) / F.when(high > low, high - low).otherwise(1.0) * 65535).cast("int")


def unit_sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """x, y and z on the unit sphere."""
    return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def chord_km(chord: Column) -> Column:
    """Kilometres along the sphere for a straight distance in radii."""
    return 2 * RADIUS_KM * F.asin(F.least(chord / 2, F.lit(1.0)))


def plane_km(lat: Column, lon: Column, lat0: float = 54.0) -> tuple[Column, Column]:
    """Kilometres on a plane, true at one latitude: degrees of 111.32 and 110.57 km."""
    return lon * 111.32 * F.cos(F.radians(F.lit(lat0))), lat * 110.57


def in_rings(points: DataFrame, rings: DataFrame, bin: float) -> DataFrame:
    """points (id, x, y) with `cell`: the first cell whose ring (cell, ring: array of points x, y) holds the point, null for none.

    Bins of a ring's bounds and those of the points meet in an equi-join; the even-odd rule then goes over the ring's
    edges. Equal points are looked up once, and of equal rings only the first cell's is kept.
    """
    at = lambda c: F.floor(c / bin)
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    span = lambda v: F.sequence(at(F.array_min(v)), at(F.array_max(v)))
    r = rings.groupBy("ring").agg(F.min("cell").alias("cell")).withColumn("_bx", F.explode(span(xs))).withColumn("_by", F.explode(span(ys)))
    j = points.select("x", "y").distinct().withColumn("_bx", at(F.col("x"))).withColumn("_by", at(F.col("y"))).join(r, ["_bx", "_by"])
    before = F.concat(F.slice("ring", -1, 1), F.slice("ring", F.lit(1), F.size("ring") - 1))
    edge = lambda a, b: (a["y"] > F.col("y")) != (b["y"] > F.col("y"))
    cross = lambda a, b: edge(a, b) & (F.col("x") < (b["x"] - a["x"]) * (F.col("y") - a["y"]) / (b["y"] - a["y"]) + a["x"])
    odd = F.size(F.filter(F.zip_with("ring", before, lambda a, b: F.coalesce(cross(a, b), F.lit(False))), lambda c: c)) % 2 == 1
    held = j.where(odd).groupBy("x", "y").agg(F.min("cell").alias("cell"))
    return points.join(held, ["x", "y"], "left").select(*points.columns, "cell")
