"""Ranges, matches, taxa tables, rasters and a study's batches against plain versions."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldqueue.operators import ranges, raster, taxa
from fieldqueue.streaming import study


def km(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


def test_nearest_cell_at_any_distance(spark):
    r = random.Random(1)
    place = lambda: (r.uniform(-90, 90), r.uniform(-180, 180))
    near = lambda p, d: (max(-90, min(90, p[0] + r.gauss(0, d))), p[1] + r.gauss(0, d))
    spots = [place() for _ in range(4)]
    cells = {"a": [near(s, 2) for s in spots for _ in range(60)], "b": [(90.0, 0.0), (-90.0, 10.0)], "c": [(0.0, 179.9), (0.0, -179.9), (0.0, 0.0)], "d": [(45.0, 45.0)] * 3}
    points = [(k, *p) for k in cells for p in [place() for _ in range(40)] + [near(s, 3) for s in spots for _ in range(10)] + [(0.0, 180.0), (90.0, 33.0), (45.0, 45.0)]]
    rows = [(i, *p) for i, p in enumerate(points)] + [(9000, "a", None, 1.0), (9001, "none", 1.0, 1.0), (9002, None, 1.0, 1.0), (9003, *points[0]), (9004, *points[0])]
    got = ranges.nearest_of(spark.createDataFrame(rows, "id long, key string, lat double, lon double"), spark.createDataFrame([(k, i, *map(float, p)) for k, v in cells.items() for i, p in enumerate(v)] + [("a", 999, None, 1.0)], "key string, cell long, lat double, lon double")).collect()
    assert len(got) == len(rows)
    for x in got:
        if x["id"] >= 9000 and x["id"] < 9003:
            assert x["cell"] is None and x["km"] is None
            continue
        d = [km((x["lat"], x["lon"]), c) for c in cells[x["key"]]]
        assert x["km"] == pytest.approx(min(d), abs=1e-5) and d[x["cell"]] == pytest.approx(min(d), abs=1e-5)
        if x["key"] == "d":
            assert x["cell"] == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_are_those_of_taking_best_pairs_first(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randint(1, 6) / 6, a, p) for a in range(25) for p in range(20) if r.random() < 0.5]
    pairs += [(1 - i / 100, 100 + i // 2, 100 + (i + 1) // 2) for i in range(12)]  # a chain that one pair after another rules
    got = {(x["area"], x["place"]) for x in ranges.matched(spark.createDataFrame(pairs, "score double, area int, place int").repartition(4)).collect()}
    areas, places, want = set(), set(), set()
    for _, a, p in sorted(pairs, key=lambda t: (-t[0], t[2], t[1])):
        if a not in areas and p not in places:
            want.add((a, p))
            areas.add(a)
            places.add(p)
    assert got == want


def test_pairs_of_areas_and_places_by_rule(spark):
    areas = spark.createDataFrame([(1, "Garibaldi Park", "park"), (2, "Strathcona", "park"), (3, "Elk Lake", "ecological reserve"), (4, "", "park")], "area int, name string, kind string")
    places = spark.createDataFrame([(10, "Garibaldi Park", "park"), (11, "Strathcona", "conservancy"), (12, "Whatever Reserve", "ecological reserve"), (13, "Elk Lake", "ecological reserve"), (14, "Unnamed", None)], "place int, name string, kind string")
    overlap = spark.createDataFrame([(1, 10, 0.95, 0.97, 0.98), (2, 11, 0.99, 1.0, 0.99), (3, 12, 0.92, 0.95, 0.96), (2, 13, 1.0, 1.0, 1.0), (4, 14, 1.0, 1.0, 1.0), (1, 12, 0.1, 0.1, 0.9)], "area int, place int, iou double, of_area double, of_place double")
    got = {(x["area"], x["place"]): x["method"] for x in ranges.scored_pairs(areas, places, overlap).collect()}
    # another kind, another area's name, no kind stated and too little overlap rule pairs out
    assert got == {(1, 10): "name+geometry", (3, 12): "geometry"}


def test_trees_are_filled_up_to_the_root(spark):
    s = "taxon_id long, parent long, latin string, common string, rank string"
    source = spark.createDataFrame([(i, i - 1 if i > 1 else None, f"l{i}", None, "r") for i in range(1, 9)] + [(20, 99, "gap", None, "r")], s)
    tree = spark.createDataFrame([(8, 7, "own", None, "r")], s)
    wanted = spark.createDataFrame([(8,), (20,), (77,), (None,)], "taxon_id long")
    got = {r["taxon_id"]: r["latin"] for r in taxa.filled(tree, wanted, source).collect()}
    assert got == {8: "own", 20: "gap", **{i: f"l{i}" for i in range(1, 8)}}
    records = spark.createDataFrame([(8, "x8", "c", "species"), (8, None, None, "species"), (5, "x5", None, None), (None, "no", None, None)], "taxon_id long, taxon_name string, common_name string, rank string")
    table, whole = taxa.taxa_table(records, source)
    rows = {r["taxon_id"]: r for r in table.collect()}
    assert whole and set(rows) == set(range(1, 9)) and [rows[i]["row"] for i in (8, 5, 1, 2, 3, 4, 6, 7)] == list(range(8))
    assert (rows[8]["latin"], rows[8]["common"], rows[8]["own"], rows[8]["parent"]) == ("x8", "c", 2, rows[7]["row"]) and rows[1]["parent"] == -1
    assert not taxa.taxa_table(records, source.where("taxon_id <> 3"))[1]
    ring = spark.createDataFrame([(8, 5, "", None, "r"), (5, 8, "", None, "r")], s)
    assert not taxa.taxa_table(records, ring)[1] and not taxa.taxa_table(records)[1]


def test_raster_of_two_clades(spark):
    r = np.random.default_rng(4)
    a, b = r.normal((0, 0), 1, (3000, 2)), r.normal((6, 0), 1, (2000, 2))
    points = [(float(x), float(y), "a") for x, y in a] + [(float(x), float(y), "b") for x, y in b] + [(30.0, 30.0, "stray"), (3.0, 0.5, None)]
    d = spark.createDataFrame(points, "x double, y double, clade string")
    box = raster.extent(d)
    assert -6 < box[0] < -2 and 8 < box[2] < 12
    grid = spark.createDataFrame([(3, 2, 8.0), (0, 0, 1.0)], "cx int, cy int, n double")
    got = {(x["cx"], x["cy"]): x["n"] for x in raster.blurred(grid, 1.0, 7, 6).collect()}
    w = dict(raster.kernel(1.0))
    for x in range(7):
        for y in range(6):
            want = sum(n * w.get(x - i, 0) * w.get(y - j, 0) for i, j, n in ((3, 2, 8.0), (0, 0, 1.0)))
            assert got.get((x, y), 0) == pytest.approx(want)
    cells = raster.regions(d, "clade", long=40, sigma=1.0).toPandas()
    assert set(cells.clade) == {"a", "b"} and cells[cells.clade == "a"].cx.max() < 28 < cells[cells.clade == "b"].cx.max()
    gaps = raster.spread_into_gaps(spark.createDataFrame([(0, 0, "a"), (1, 0, None), (2, 0, None), (3, 0, "b"), (9, 9, None)], "cx int, cy int, clade string"), "clade")
    assert {(x["cx"], x["clade"]) for x in gaps.collect()} == {(0, "a"), (1, "a"), (2, "b"), (3, "b")}


SIZES = {"A": {"g": 3, "h": 1}, "B": {"g": 2}, "C": {"g": 4, "h": 2}}


def plain_study(presses):
    out, state = {}, {}
    for browser, grp, press in presses:
        order = study.turn_order(browser, SIZES, 7)
        s = state.setdefault((browser, grp), {"turn": 0, "seen": {}, "n": 0})
        got = None
        for k in range(len(order)):
            label = order[(s["turn"] + k) % len(order)]
            if s["seen"].get(label, 0) < SIZES[label].get(grp, 0):
                n = SIZES[label][grp]
                got = (label, (study.offset(browser, label, grp, n, 7) + s["seen"].get(label, 0)) % n)
                s["seen"][label] = s["seen"].get(label, 0) + 1
                s["turn"] += k + 1
                s["n"] += 1
                break
        else:
            s["turn"] += len(order)
        out[press] = (*(got or (None, None)), s["n"])
    return out


def test_a_study_is_served_as_the_plain_simulation(spark, tmp_path):
    r = random.Random(2)
    presses = [(f"u{r.randint(0, 3)}", r.choice("gh"), i) for i in range(120)]
    at = lambda i: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=30 * i)
    folder = str(tmp_path / "in")
    for part in range(3):
        rows = [(b, g, i, at(i)) for b, g, i in presses[40 * part : 40 * part + 40]]
        spark.createDataFrame(rows, "browser string, grp string, press long, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
    q = study.serve(spark.readStream.schema("browser string, grp string, press long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder), SIZES, seed=7)
    run = q.writeStream.format("memory").queryName("study_served").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {x["press"]: (x["label"], x["idx"], x["number"]) for x in spark.table("study_served").collect()}
    assert got == plain_study(presses)
    for b in {x[0] for x in presses}:
        for g in "gh":
            mine = [got[p][:2] for bb, gg, p in presses if (bb, gg) == (b, g) and got[p][0]]
            assert len(mine) == len(set(mine))  # no batch twice
