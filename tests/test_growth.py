"""Work that must not grow faster than its input, and the forms that larger tables take."""

from __future__ import annotations

import time
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fieldqueue.functions import hashing
from fieldqueue.operators import assembly, consensus, geo, inference, outcomes, ranges, rotated, tables, taxa, vectors


def test_a_record_of_many_answers_goes_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(u) if u else None, int(r), [None, "a", "b", "c"][c]) for u, r, c in zip(rng.integers(0, 30, 600), rng.integers(0, 60, 600), rng.integers(0, 4, 600))]
    answers = spark.createDataFrame(rows + [(None, 99, "a")], "login long, record long, label string")
    known = spark.createDataFrame([(0, "a"), (1, "z"), (2, "b")], "record long, label string")
    found = lambda: {r["record"]: (r["label"], round(r["posterior"], 6)) for r in consensus.consensus(answers, 4, known).collect()}
    whole = found()
    assert len(whole) == 60 and 99 not in whole
    monkeypatch.setattr(consensus, "PACK", 9)
    assert consensus.prepared(answers).long is not None and found() == whole
    monkeypatch.setattr(consensus, "LOGINS", 5)
    assert consensus.prepared(answers).packed is None and found() == whole


def test_draws_are_those_of_the_hash(spark):
    tails = [b":1", b":22", b"", b":" + b"x" * 60]
    want = [[int((tables.POISSON <= int(md5(b"3:%d" % r + t).hexdigest()[:13], 16)).sum()) for r in range(1, 121)] for t in tails]
    assert tables.draws(3, 120, tails).tolist() == want
    rows = spark.createDataFrame([(i, g, i % 2) for i in range(40) for g in "ab"] + [(None, None, 1)], "u long, g string, y int")
    got = {r["g"]: r for r in tables.cluster_bootstrap(rows, "u", "g", "y", 50, 3).collect()}
    w = tables.draws(3, 50, [b":%d" % i for i in range(40)])
    rates = w[np.arange(40) % 2 == 1].sum(0) / w.sum(0)
    assert set(got) == {"a", "b"} and got["a"]["rate"] == 0.5 and np.isclose(got["b"]["high"], np.percentile(rates, 97.5))


def test_taxa_beyond_sixteen_bits(spark):
    r = spark.range(1, 65_541).select(F.col("id").alias("taxon_id"), F.lit("x").alias("taxon_name"), F.lit(None).cast("string").alias("common_name"), F.lit("r").alias("rank"))
    assert taxa.taxa_table(r)[0].agg(F.max("row")).first()[0] == 65_539


def test_matches_by_class_are_those_of_all_pairs(spark):
    for seed, scores in ((1, 3), (2, 50)):
        rng = np.random.default_rng(seed)
        areas = spark.createDataFrame([(i, int(c)) for i, c in enumerate(rng.integers(0, 4, 15))], "area long, a long")
        places = spark.createDataFrame([(i, int(c)) for i, c in enumerate(rng.integers(0, 5, 22))], "place long, p long")
        s = spark.createDataFrame([(a, p, float(rng.integers(0, scores))) for a in range(4) for p in range(5) if (a + p) % 4], "a long, p long, score double")
        pairs = areas.join(s, "a").join(places, "p").select("score", "area", "place")
        want = sorted(map(tuple, ranges.matched(pairs).collect()))
        assert want and sorted(map(tuple, ranges.matched_classes(areas, places, s).collect())) == want


def test_equal_points_and_rings_meet_once(spark):
    p = spark.range(20_000).select("id", F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    point = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    r = spark.range(5, 20_000).select(F.col("id").alias("cell"), F.array(point(0.0, 0.0), point(4.0, 0.0), point(0.0, 4.0)).alias("ring"))
    began = time.time()
    assert geo.in_rings(p, r, 10.0).groupBy("cell").count().collect() == [(5, 20_000)] and time.time() - began < 60


def test_nearest_cell_meets_cells_of_neighbouring_cubes_only(spark):
    p = spark.range(30_000).select("id", F.lit(50.0).alias("lat"), (F.col("id") % 10_000 / 100 - 180).alias("lon"))
    c = spark.range(30_000).select(F.col("id").alias("cell"), F.lit(50.0).alias("lat"), (F.col("id") % 20_000 / 60 - 180).alias("lon"))
    began = time.time()
    got = geo.nearest_cell(p, c, 5.0)
    n, cells = got.agg(F.count("cell"), F.count_distinct("cell")).first()
    assert n > 9_000 and cells > 1_000 and time.time() - began < 60
    # across the date line, and the smaller of two cells at one place
    p = spark.createDataFrame([(1, 10.0, 179.99), (2, None, 1.0), (3, 89.99, 10.0)], "id long, lat double, lon double")
    c = spark.createDataFrame([(7, 10.0, -179.99), (4, 10.0, -179.99), (9, 89.99, -170.0)], "cell long, lat double, lon double")
    assert {r["id"]: r["cell"] for r in geo.nearest_cell(p, c, 20.0).collect()} == {1: 4, 2: None, 3: 9}


def test_queries_of_a_list_are_scored_in_turns(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 8)))], "id long, v array<double>")
    b = rotated.train(rows, 2, 2, 8)
    index = rotated.encoded(rows, b)
    found = lambda: sorted((r["id"], r["place"], r["nb"]) for r in rotated.search(index, rows, b, 3, 2, 50).collect())
    whole = found()
    assert len(whole) == 600
    monkeypatch.setattr(rotated, "ASKED", 30)
    assert found() == whole


def test_neighbours_alike_to_twelve_digits_go_by_id(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "id long, v array<double>")
    c = spark.createDataFrame([(9, [1.0, 0.0]), (5, [1.0, 1.4e-7]), (7, [1.0, 1.0]), (0, [1.0, 0.0])], "id long, v array<double>")
    assert [(r["place"], r["nb"]) for r in vectors.exact_neighbours(q, c, 1).collect()] == [(1, 5)]
    assert [r["nb"] for r in vectors.exact_neighbours(q, c, 9).orderBy("place").collect()] == [5, 9, 7]


def test_coins_of_signs_are_dealt_out_by_their_hash(spark, monkeypatch):
    digits = np.arange(10, 100)
    for prefix in (b"3:", b"4" * 50):
        want = [[int(md5(prefix + b"%d" % r + t).hexdigest()[:15], 16) for r in digits.tolist()] for t in (b":1:0", b":2500000000:17")]
        assert hashing.md5_heads(hashing.numbered(prefix, digits), [b":1:0", b":2500000000:17"]).tolist() == want
    sizes = [1.0] * 130 + [-2.5] * 70 + [0.5] * 3
    rows = spark.createDataFrame([(k, x) for k in "ab" for x in sizes] + [("c", 0.0), ("c", None)], "arm string, d double")
    ones = lambda r, v, w, k: (int(md5(f"3:{r}:{round(v * 1e9)}:{w}".encode()).hexdigest()[:15], 16) & (1 << k) - 1).bit_count()
    words = [(1.0, 0, 60), (1.0, 1, 60), (1.0, 2, 10), (2.5, 0, 60), (2.5, 1, 10), (0.5, 0, 3)]
    sums = [sum(v * (2 * ones(r, v, w, k) - k) for v, w, k in words) for r in range(1, 121)]
    total = sum(sizes)
    want = (sum(abs(s) >= abs(total) - 1e-9 for s in sums) + 1) / 121
    monkeypatch.setattr(inference, "HASHES", 120 * 2)  # two words a task
    got = inference.sign_flip(rows, ["arm"], 120, 3)
    assert {r["arm"]: (r["total"], r["p"]) for r in got.collect()} == {"a": (total, want), "b": (total, want), "c": (0.0, 1.0)}


def test_a_bootstrap_in_turns_draws_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i % 7, i % 5, i % 3) for i in range(90)], "user_id long, t long, u long, control long")
    found = lambda: [tuple(r) for r in inference.ratio_interval(rows, ["control", "t", "u"], "control", 300, 2).orderBy("arm").collect()]
    whole = found()
    monkeypatch.setattr(inference, "DRAWN", 100)
    assert found() == whole
    assert inference.ratio_interval(rows, ["control", "t"], "control", 0, 2).first()["ratio_lo"] is None


def test_coverage_is_found_without_vectors(spark):
    base = spark.createDataFrame([("g", 1, [1.0]), ("h", 2, [2.0]), ("g", 3, None), ("g", 4, [4.0]), ("g", 5, [5.0])], "grp string, id long, v array<double>")
    deltas = spark.createDataFrame([("d1", 2, [6.0]), ("d1", 4, [7.0]), ("d2", 4, None), ("base", 5, [-5.0]), (None, 1, [8.0])], "name string, id long, v array<double>")
    pool = spark.createDataFrame([(i, "g", None) for i in range(1, 7)], "id long, grp string, created_at timestamp")
    rows = assembly.covered(pool, base, deltas)
    assert "v" not in rows.columns
    # the last delta counts even where it holds no vector
    assert {r["id"]: r["origin"] for r in rows.collect()} == {1: "base", 2: "d1", 3: None, 4: None, 5: "base", 6: None}
    got = assembly.assemble(pool, base, deltas, grace_hours=1)
    assert {r["id"]: (r["origin"], r["v"]) for r in got.vectors.collect()} == {1: ("base", [1.0]), 2: ("d1", [1.0]), 5: ("base", [-1.0])}
    assert [tuple(r) for r in got.groups.collect()] == [("g", 6, 3, 0)]


def test_margins_against_references_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v, m = rng.standard_normal((70, 8)), rng.standard_normal((9, 8))
    u, m = v / np.linalg.norm(v, axis=1)[:, None], m / np.linalg.norm(m, axis=1)[:, None]
    labels = [None if i % 10 == 9 else i % 12 for i in range(70)]
    rows = spark.createDataFrame([(i, k, x.tolist()) for i, (k, x) in enumerate(zip(labels, v))], "id long, label int, v array<double>")
    refs = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)] + [(None, m[0].tolist())], "label int, m array<double>")
    for classes, strip in ((4096, 256), (4, 16)):
        monkeypatch.setattr(vectors, "CLASSES", classes)
        monkeypatch.setattr(vectors, "STRIP", strip)
        got = {r["id"]: r for r in vectors.reference_scores(rows, refs).collect()}
        for i, k in enumerate(labels):
            s = u[i] @ m.T
            assert (got[i]["own"] is None) == (k is None or k > 8) and (k is None or k > 8 or np.isclose(got[i]["own"], s[k]))
            assert got[i]["other"] is None if k is None else np.isclose(got[i]["other"], max(x for j, x in enumerate(s) if j != k))


def test_the_length_of_a_vector_is_found_once(spark):
    d = spark.createDataFrame([(1, [3.0, 4.0]), (2, None)], "id long, v array<double>").select("id", vectors.unit("v").alias("u"))
    assert {r["id"]: r["u"] for r in d.collect()} == {1: [0.6, 0.8], 2: None}
    # a wide vector took the square of its width
    wide = spark.range(40).select(F.transform(F.sequence(F.lit(1), F.lit(8192)), lambda x: x.cast("double")).alias("v"))
    began = time.time()
    wide.select(vectors.unit("v").alias("u")).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 20


def test_novelty_holds_strips_and_equal_references_once(spark, monkeypatch):
    rng = np.random.default_rng(7)
    v, r = rng.standard_normal((60, 4)), rng.standard_normal((10, 4))
    rows = spark.createDataFrame([(i, i % 2, x.tolist()) for i, x in enumerate(v)], "id long, grp int, v array<double>")
    refs = spark.createDataFrame([(g, x.tolist()) for g in (0, 1) for x in r for _ in range(50)], "grp int, v array<double>")
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit(v) @ unit(r).T).max(1)
    monkeypatch.setattr(outcomes, "STRIP", 7)
    got = {x["id"]: x["cos"] for x in outcomes.nearest_reference(rows, refs, 16).collect()}
    assert np.allclose([got[i] for i in range(60)], want)


def test_codes_of_a_batch_are_made_a_slice_at_a_time(spark):
    batches = [pa.RecordBatch.from_pydict({"x": list(range(2 * rotated.SLICE + 3))}), pa.RecordBatch.from_pydict({"x": [1]}).slice(0, 0)]
    cut = list(rotated.sliced(iter(batches)))
    assert [b.num_rows for b in cut] == [rotated.SLICE, rotated.SLICE, 3] and sum((b.column(0).to_pylist() for b in cut), []) == list(range(2 * rotated.SLICE + 3))
    rows = spark.createDataFrame([(i, np.random.default_rng(i).standard_normal(8).tolist()) for i in range(700)], "id long, v array<double>").repartition(1)
    books = rotated.train(rows, 4, 2, 16)
    back = rotated.reconstructed(rotated.encoded(rows, books), books)
    assert sorted(r["id"] for r in back.collect()) == list(range(700))
