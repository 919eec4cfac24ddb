"""Surprise against brute force, and bundles that are published or refused as a whole."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldqueue.operators import assembly, ordering, surprise


def plain_density(ref, q, h):
    return np.exp(-((q[:, None, :] - ref[None, :, :]) ** 2).sum(-1) / (2 * h * h)).sum(1)


@pytest.mark.parametrize("error", [1e-3, 1e-6, 1e-9])
def test_densities_are_within_the_error(spark, monkeypatch, error):
    monkeypatch.setattr(surprise, "POINTS", 300)
    r = np.random.default_rng(1)
    ref = {k: np.concatenate([r.normal(0, 4, (n, 2)), r.normal(30, 1, (n // 2, 2)), np.full((n // 3, 2), 2.5)]) for k, n in (("a", 600), ("b", 30), ("c", 1))}
    q = {k: np.concatenate([r.uniform(-40, 70, (400, 2)), ref.get(k, np.zeros((0, 2)))[:200]]) for k in ("a", "b", "c", "none")}
    rows = lambda d: spark.createDataFrame([(k, i, float(x), float(y)) for k, v in d.items() for i, (x, y) in enumerate(v)], "key string, id long, x double, y double")
    got = surprise.densities(rows(ref), rows(q), 3.0, error).collect()
    assert len(got) == sum(map(len, q.values()))
    for k, v in q.items():
        mine = {x["id"]: x["density"] for x in got if x["key"] == k}
        want = plain_density(ref[k], v, 3.0) if k in ref else np.zeros(len(v))
        worst = np.abs(np.array([mine[i] for i in range(len(v))]) - want).max()
        assert worst <= error * max(1, len(ref.get(k, ())))


def test_tail_is_the_plain_one(spark):
    r = np.random.default_rng(2)
    ref = {"a": r.normal(0, 5, (300, 2)), "b": r.normal(0, 5, (7, 2)), "few": r.normal(0, 5, (4, 2)), "same": np.ones((9, 2))}
    q = r.normal(0, 8, (60, 2))
    refs = [(k, i, *map(float, p)) for k, v in ref.items() for i, p in enumerate(v)] + [("few", 99, None, 1.0), ("few", 98, float("nan"), 1.0), (None, 1, 0.0, 0.0)]
    asked = [(k, 1000 * j + i, *map(float, p)) for j, k in enumerate([*ref, "none"]) for i, p in enumerate(q)] + [("a", -1, None, None), ("a", -2, float("nan"), 0.0), (None, -3, 0.0, 0.0)]
    s = "key string, id long, x double, y double"
    got = {(x["key"], x["id"]): x for x in surprise.tail(spark.createDataFrame(refs, s), spark.createDataFrame(asked, s), 2.0, error=1e-9).collect()}
    assert len(got) == len(asked) - 1 and got["a", -1]["tail"] is None and got["a", -2]["tail"] is None
    for j, k in enumerate([*ref, "none"]):
        v = ref.get(k, np.zeros((0, 2)))
        n = len(v)
        own = (plain_density(v, v, 2.0) - 1) * n / max(n - 1, 1)
        d = plain_density(v, q, 2.0) if n else np.zeros(len(q))
        for i in range(len(q)):
            want = 1.0 if n < 5 else (np.round(own, 9) > np.round(d[i], 9)).mean()
            assert got[k, 1000 * j + i]["tail"] == pytest.approx(want) and got[k, 1000 * j + i]["n"] == n


def test_sums_before_rows_of_groups_of_any_size(spark):
    d = spark.range(5000).selectExpr("if(id % 10 < 7, 'hot', string(id % 3)) as g", "id", "id % 13 as w").repartition(7)
    got = ordering.summed_before(d, ["g"], [F.col("id").desc()], "w", "before").toPandas().sort_values("id", ascending=False)
    assert len(got) == 5000 and (got.before == got.groupby("g").w.cumsum() - got.w).all()


def test_ranks_of_subspecies_and_gaps(spark):
    taxa = spark.createDataFrame([(1, 40, None), (2, 20, [1]), (3, 10, [1, 2]), (4, 5, [1, 2, 3]), (5, 15, [1]), (6, 10, [77, 2])], "taxon_id long, rank_level int, ancestry array<bigint>")
    got = {r["taxon_id"]: (r["species"], r["genus"], r["order"]) for r in surprise.ranks(taxa, {"species": 10, "genus": 20, "order": 40}).collect()}
    assert got == {1: (None, None, 1), 2: (None, 2, 1), 3: (3, 2, 1), 4: (3, 2, 1), 5: (None, None, 1), 6: (6, 2, None)}


def test_extent_holds_for_one_kernel():
    for error in (1e-2, 1e-5):
        reach, terms = surprise.extent(error)
        t, s = np.meshgrid(np.linspace(-reach, reach, 101), np.linspace(-0.5, 0.5, 21))
        series = np.exp(-(t * t + s * s) / 2) * sum((t * s) ** k / math.factorial(k) for k in range(terms))
        assert np.abs(series - np.exp(-((t - s) ** 2) / 2)).max() <= error / 4 and math.exp(-reach * reach / 2) <= error / 2


DAY = datetime.datetime(2026, 1, 1)


def bundle_parts(spark, late=0):
    ago = lambda h: DAY - datetime.timedelta(hours=h)
    pool = [(i, "g" if i < 100 else "h", ago(500 if i < 90 else 10)) for i in range(110)] + [(900, None, ago(1))]
    have = [i for i in range(110) if i % 10 != 9 or i < 90 and i % 10 == 9 and i >= 10 * late]
    base = [("g" if i < 100 else "h", i, [3.0, 4.0]) for i in have if i % 4] + [("h", 2, [9.0, 9.0])]
    deltas = [("d1", i, [0.0, 2.0]) for i in have if i % 4 == 0 or i % 5 == 0] + [("d2", 8, [-5.0, 0.0]), ("d2", 5000, [1.0, 1.0])]
    return spark.createDataFrame(pool, "id long, grp string, created_at timestamp"), spark.createDataFrame(base, "grp string, id long, v array<double>"), spark.createDataFrame(deltas, "name string, id long, v array<double>")


def test_later_vectors_win_and_what_is_fresh_may_lack_one(spark, tmp_path):
    pool, base, deltas = bundle_parts(spark)
    b = assembly.assemble(pool, base, deltas)
    v = {r["id"]: (r["origin"], [round(x, 9) for x in r["v"]]) for r in b.vectors.collect()}
    assert v[1] == ("base", [0.6, 0.8]) and v[5] == ("d1", [0.0, 1.0]) and v[8] == ("d2", [-1.0, 0.0]) and v[2] == ("base", [0.6, 0.8]) and 5000 not in v
    bare = {r["id"] for r in b.uncovered.collect()}
    assert bare == {99, 109} and {r["id"] for r in b.pool.collect()} == set(range(110)) - bare | {900} and set(v) == set(range(110)) - bare
    folder = f"file://{tmp_path}"
    assembly.published(b, folder)
    assert assembly.current(spark, folder).vectors.count() == 108
    fewer = assembly.assemble(pool.where("id < 50"), base, deltas)
    name = assembly.published(fewer, folder)
    assert assembly.current(spark, folder).vectors.count() == 50 and name.startswith("bundle-")


def test_bundles_behind_are_refused_as_a_whole(spark):
    pool, base, deltas = bundle_parts(spark, late=2)
    with pytest.raises(assembly.Refused, match=r"g has 2 of 100 records older than 48 h"):
        assembly.assemble(pool, base, deltas)
    assert assembly.assemble(pool, base, deltas, most_uncovered=0.02).uncovered.count() == 4
    # grace: none of them is late if the pool's newest record is no older than that
    assert assembly.assemble(pool, base, deltas, grace_hours=600).uncovered.count() == 4
    # records that the list of open ones doesn't know, and that aren't newer than all of it, don't count
    open_pool = pool.where("id not in (9, 19)")
    assert {r["grp"]: r["late"] for r in assembly.assemble(pool, base, deltas, open_pool=open_pool).groups.collect()} == {"g": 0, "h": 0}
    stalled = spark.createDataFrame([(7, DAY - datetime.timedelta(hours=9999))], "id long, created_at timestamp")
    with pytest.raises(assembly.Refused):
        assembly.assemble(pool, base, deltas, open_pool=stalled)


def test_unsound_parts_of_bundles(spark):
    pool, base, deltas = bundle_parts(spark)
    with pytest.raises(ValueError, match="holds id 3 2 times"):
        assembly.assemble(pool.unionByName(pool.where("id = 3")), base, deltas)
    for v in ([0.0, 0.0], [float("nan"), 1.0], [None, 1.0], [1.0, 2.0, 3.0]):
        odd = spark.createDataFrame([("d9", 4, v)], "name string, id long, v array<double>")
        with pytest.raises(Exception, match="finite and nonzero|dimensions"):
            assembly.assemble(pool, base, deltas.unionByName(odd)).vectors.collect()
    none = assembly.assemble(pool.limit(0), base, deltas)
    assert none.vectors.count() == none.pool.count() == none.groups.count() == 0
