"""Rasters of points by clade: counts, a separable blur, the land, the leading clade of each cell and smooth borders."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldqueue.sources.shared import kept

# fixed values: share of points left out at each end of the extent, its padding, bins, and the cut of the land below the lower quartile
STRAY, PADDING, BINS, LAND = 0.002, 0.02, 4096, 0.5


def kernel(sigma: float) -> list[tuple[int, float]]:
    """Offsets and weights of a Gaussian as far as three deviations, which sum to 1."""
    r = max(1, math.ceil(3 * sigma))
    w = [math.exp(-i * i / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    return [(i - r, v / sum(w)) for i, v in enumerate(w)]


def extent(points: DataFrame) -> tuple[float, float, float, float]:
    """The padded box (x0, y0, x1, y1) that leaves out STRAY of the points (x, y) at each end, from histograms of BINS bins: a few strays don't shrink the map."""
    ends = points.agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("l", F.min), ("h", F.max))]).first()
    box = []
    for c in "xy":
        low = float(ends[f"l{c}"] or 0.0)
        high = float(ends[f"h{c}"] or 0.0)
        high = high if high > low else low + 1
        scale = BINS / (high - low) * (1 - 1e-9)
        hist = points.where(F.col(c).isNotNull()).groupBy(F.floor((F.col(c) - low) * scale).alias("b")).count().collect()  # at most BINS rows
        n = [0] * BINS
        for r in hist:
            n[r["b"]] = r["count"]

        def first(counts: list[int]) -> int:
            seen = 0
            for i, k in enumerate(counts):
                seen += k
                if seen > STRAY * sum(n):
                    return i
            return 0

        a, b = low + first(n) / scale, low + (BINS - first(n[::-1])) / scale
        box.append((a - (b - a) * PADDING, b + (b - a) * PADDING))
    return box[0][0], box[1][0], box[0][1], box[1][1]


def shape(box: tuple[float, float, float, float], long: int) -> tuple[int, int]:
    """Columns and rows of square cells, `long` along the longer side."""
    dx, dy = box[2] - box[0] or 1, box[3] - box[1] or 1
    side = max(dx, dy) / long
    return max(1, int(dx / side + 0.5)), max(1, int(dy / side + 0.5))


def cells(points: DataFrame, box: tuple[float, float, float, float], w: int, h: int, *by: str) -> DataFrame:
    """(by, cx, cy, n): points (x, y) in each cell; those outside the box are left out."""
    cx = F.floor((F.col("x") - box[0]) * (w / ((box[2] - box[0]) or 1))).cast("int")
    cy = F.floor((F.col("y") - box[1]) * (h / ((box[3] - box[1]) or 1))).cast("int")
    n = points.groupBy(*by, cx.alias("cx"), cy.alias("cy")).agg(F.count("*").cast("double").alias("n"))
    return n.where(F.col("cx").between(0, w - 1) & F.col("cy").between(0, h - 1))


def blurred(grid: DataFrame, sigma: float, w: int, h: int, *by: str) -> DataFrame:
    """(by, cx, cy, n) after a Gaussian blur, zero outside the grid: each cell is spread along its row, then along its column, so that a cell makes as many rows as the kernel is long, twice."""
    taps = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(v).alias("v")) for i, v in kernel(sigma)])
    out = grid
    for c, size in (("cx", w), ("cy", h)):
        s = out.withColumn("_t", F.explode(taps)).withColumn(c, F.col(c) + F.col("_t.o")).where(F.col(c).between(0, size - 1))
        out = s.groupBy(*by, "cx", "cy").agg(F.sum(F.col("n") * F.col("_t.v")).alias("n"))
    return out


def land(total: DataFrame) -> DataFrame:
    """(cx, cy) of the cells whose density is above half the lower quartile of those that have any."""
    some = total.where("n > 0")
    m = some.count()
    if not m:
        return total.select("cx", "cy")
    at = int(0.25 * (m - 1))
    # the quartile is a cell's own density, of a raster's bounded number of cells
    quartile = some.orderBy("n").limit(at + 1).agg(F.max("n")).first()[0]
    return some.where(F.col("n") > LAND * quartile).select("cx", "cy")


def leading(planes: DataFrame, ground: DataFrame, by: str) -> DataFrame:
    """(cx, cy, by): the clade with the greatest density in each cell of the land, ties to the first; null where none has any."""
    best = planes.where("n > 0").groupBy("cx", "cy").agg(F.min(F.struct((-F.round("n", 9)).alias("_n"), by)).alias("b"))
    return ground.join(best, ["cx", "cy"], "left").select("cx", "cy", F.col(f"b.{by}").alias(by))


def spread_into_gaps(codes: DataFrame, by: str) -> DataFrame:
    """Gives cells without a clade that of the nearest one by steps to the four neighbours, ties to the first clade; what nothing reaches is left out."""
    now = kept(codes)
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    while True:
        bare = now.where(F.col(by).isNull()).select("cx", "cy")
        near = now.where(F.col(by).isNotNull()).withColumn("_s", steps).select((F.col("cx") + F.col("_s.a")).alias("cx"), (F.col("cy") + F.col("_s.b")).alias("cy"), by)
        found = kept(bare.join(near, ["cx", "cy"]).groupBy("cx", "cy").agg(F.min(by).alias(by)))
        if found.isEmpty():
            return now.where(F.col(by).isNotNull())
        now = kept(now.join(found.withColumnRenamed(by, "_new"), ["cx", "cy"], "left").select("cx", "cy", F.coalesce(by, "_new").alias(by)))


def majority(codes: DataFrame, by: str) -> DataFrame:
    """Each cell's commonest clade among the nine cells around and with it; its own stays unless another is more frequent, of equal ones the first."""
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    votes = codes.withColumn("_s", around).select((F.col("cx") + F.col("_s.a")).alias("cx"), (F.col("cy") + F.col("_s.b")).alias("cy"), F.col(by).alias("_v"))
    n = codes.join(votes, ["cx", "cy"]).groupBy("cx", "cy", by, "_v").agg(F.count("*").alias("n"))
    other = (F.col("_v") != F.col(by)).cast("int")
    best = n.groupBy("cx", "cy").agg(F.min(F.struct((-F.col("n")).alias("n"), other.alias("o"), "_v")).alias("b"))
    return best.select("cx", "cy", F.col("b._v").alias(by))


def regions(points: DataFrame, by: str, long: int = 200, sigma: float = 1.5) -> DataFrame:
    """(cx, cy, by): the map of points (x, y, by): the land's cells with the clade that leads there, gaps filled from the nearest, borders rounded by majority."""
    box = extent(points)
    w, h = shape(box, long)
    planes = kept(blurred(cells(points.where(F.col(by).isNotNull()), box, w, h, by), sigma, w, h, by))
    total = kept(blurred(cells(points, box, w, h), sigma, w, h))
    return majority(spread_into_gaps(leading(planes, land(total), by), by), by)
