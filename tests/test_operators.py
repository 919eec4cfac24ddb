import hashlib
import hmac
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldqueue.functions.hashing import hmac_sha256, keyed_bucket
from fieldqueue.operators import analysis, batches, consensus, facets, geo, ordering, state, tree, vectors

KEY = b"a key"
AT = datetime(2026, 11, 1, 12)


def test_keyed_hash_is_hmac(spark):
    rows = spark.range(200).select(F.col("id").cast("string").alias("t"), hmac_sha256(KEY, F.col("id").cast("string")).alias("h"), keyed_bucket(KEY, F.col("id").cast("string"), 7).alias("b"))
    for r in rows.collect():
        d = hmac.new(KEY, r["t"].encode(), hashlib.sha256)
        assert r["h"] == d.hexdigest() and r["b"] == int.from_bytes(d.digest()[:8], "big") % 7


def test_keyed_arms_are_stable_and_even(spark):
    arms = ["c", "t"]
    whole = {r["id"]: r["arm"] for r in batches.assign_keyed(spark.range(20_000), arms, KEY).collect()}
    part = {r["id"]: r["arm"] for r in batches.assign_keyed(spark.range(0, 20_000, 7), arms, KEY).collect()}
    assert all(whole[k] == v for k, v in part.items()) and abs(sum(v == "t" for v in whole.values()) / 20_000 - 0.5) < 0.02


def test_batches_are_cut_in_order(spark):
    d = spark.createDataFrame([(i, "a", "g") for i in range(7)], "id long, arm string, group string")
    got = [(r["batch_id"], r["position"], r["id"]) for r in batches.build_batches(d, [F.col("id").desc()], 3, 2).orderBy("batch_id", "position").collect()]
    assert got == [("a-g-000", 0, 6), ("a-g-000", 1, 5), ("a-g-000", 2, 4), ("a-g-001", 0, 3), ("a-g-001", 1, 2), ("a-g-001", 2, 1)]


def test_counted_pairs_follow_the_rules(spark):
    s = spark.createDataFrame([(1, "c"), (2, "c"), (3, "t"), (4, "t")], "id long, arm string")
    day = lambda m, d: datetime(2026, m, d, 12)
    rows = [(1, 10, day(11, 1), "species"), (1, 10, day(11, 2), "subspecies"), (3, 10, day(11, 1), "species"), (4, 10, day(11, 1), "genus"), (2, 11, day(10, 1), "species"), (9, 11, day(11, 1), "species"), (3, None, day(11, 1), "species"), (4, 11, day(11, 3), "species")]
    i = spark.createDataFrame([(*r, None) for r in rows], "id long, user_id long, created_at timestamp, rank string, observer_id long")
    p = analysis.counted_pairs(i, s, F.lit("2026-11-01").cast("timestamp"), F.lit("2026-12-01").cast("timestamp"), ["species", "subspecies"])
    got = {r["user_id"]: (r["c"], r["t"]) for r in analysis.by_arm(p, s, ["c", "t"]).collect()}
    assert got == {10: (1, 1), 11: (0, 1)}
    assert {r["id"]: r["n"] for r in analysis.record_totals(p, s).collect()} == {1: 1, 2: 0, 3: 1, 4: 1}


def test_one_arm_refuses_two(spark):
    d = spark.createDataFrame([(1, "a", None, 0), (1, "a", 2.0, 1), (2, "b", None, 0)], "id long, arm string, score double, position int")
    assert {r["id"]: r["score"] for r in analysis.one_arm(d).collect()} == {1: 2.0, 2: None}
    with pytest.raises(Exception, match="more than one arm"):
        analysis.one_arm(d.withColumn("arm", F.concat("arm", "position"))).collect()


def test_orders_put_missing_scores_last(spark):
    d = spark.createDataFrame([(1, AT, float("nan")), (3, AT, 1.0), (2, AT, 1.0), (4, None, None), (5, AT, float("inf"))], "id long, created_at timestamp, s double")
    assert [r["id"] for r in d.orderBy(*ordering.by_score("s")).collect()] == [3, 2, 5, 1, 4]


def test_upsert_and_changes(spark):
    pool = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "id long, v string")
    new = spark.createDataFrame([(2, "b", 1), (4, "b", 1)], "id long, v string, extra int")
    assert {r["id"]: (r["v"], r["extra"]) for r in state.upsert(pool, new).collect()} == {1: ("a", None), 2: ("b", 1), 3: ("a", None), 4: ("b", 1)}
    gone = pool.where("id = 3")
    assert {r["id"] for r in state.apply_changes(pool, new, gone).collect()} == {1, 2, 4}
    assert {r["id"] for r in state.drop_closed(pool, pool.where("id < 3"), pool.where("id = 1")).collect()} == {1, 3}
    assert state.differences(pool, pool).count() == 0


def test_lineages_relations_and_votes(spark):
    n = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a")], "id string, parent string")
    assert {r["id"]: r["path"] for r in tree.lineages(n).collect()} == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"], "d": ["a", "d"]}
    votes = [(1, ["g", "s"]), (1, ["g", "s"]), (2, ["g", "s"]), (2, ["g", "t"]), (3, ["g", "s"]), (3, ["g", "s"]), (3, ["h", "u"]), (4, ["g"]), (4, ["g", "s"]), (4, ["g", "s"])]
    got = {r["id"]: r["node"] for r in tree.community(spark.createDataFrame(votes, "id long, path array<string>")).collect()}
    assert got == {1: "s", 2: "g", 4: "s"}  # two of three is not more than two thirds
    d = spark.createDataFrame([(["a"], ["a", "b"]), (["a", "b"], ["a"]), (["a"], ["b"]), (["a"], ["a"]), (None, ["a"])], "t array<string>, n array<string>")
    assert [r[0] for r in d.select(tree.relation(F.col("t"), F.col("n"))).collect()] == ["refined", "coarsened", "corrected", "same", "none"]


def test_nearest_cell_within_reach(spark):
    p = spark.createDataFrame([(1, 50.0, -120.0), (2, 58.0, -120.0)], "id long, lat double, lon double")
    c = spark.createDataFrame([(1, 50.1, -120.0), (2, 50.05, -120.0)], "cell long, lat double, lon double")
    got = {r["id"]: r["cell"] for r in geo.nearest_cell(p, c, 20.0).collect()}
    assert got == {1: 2, 2: None}


def test_facets(spark):
    d = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "grp string, t int")
    ids = lambda c: [r["grp"] for r in d.where(c).collect()]
    assert ids(facets.keep([], ["a"], [])) == ["b", "c"] and ids(facets.keep(["a"], [], [F.col("t") == 3])) == ["a", "c"]
    assert ids(facets.keep(["a", "b"], ["b"], [])) == ["a"]


def test_exact_neighbours_in_blocks(spark):
    x = np.random.default_rng(1).standard_normal((300, 6))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = vectors.exact_neighbours(d.where("id < 40"), d, 3, block=37).toPandas()
    u = x / np.sqrt((x * x).sum(1))[:, None]
    for q, g in got.groupby("id"):
        s = u @ u[q]
        s[q] = -9
        assert g.sort_values("place").nb.tolist() == np.argsort(-s)[:3].tolist()


def test_zero_vectors_are_refused(spark):
    with pytest.raises(Exception, match="zero or not finite"):
        spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(vectors.unit("v")).collect()


def test_consensus_trusts_the_reliable(spark):
    r = np.random.default_rng(4)
    rows, truth = [], {}
    for rec in range(150):
        truth[rec] = "ab"[int(r.integers(2))]
        for login in range(7):
            right = r.random() < (0.95 if login < 4 else 0.5)
            rows.append((login, rec, truth[rec] if right else "ab"[truth[rec] == "a"]))
    got = {x["record"]: x["label"] for x in consensus.consensus(spark.createDataFrame(rows, "login long, record long, label string")).collect()}
    assert sum(got[k] == v for k, v in truth.items()) / len(truth) > 0.97


def test_holm_and_wilson(spark):
    d = spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.03)], "name string, p double")
    assert {r["name"]: round(r["adjusted"], 6) for r in analysis.holm(d).collect()} == {"x": 0.03, "y": 0.06, "z": 0.06}
    lo, hi = analysis.wilson(F.lit(8), F.lit(10))
    r = spark.range(1).select(lo, hi).first()
    assert abs(r[0] - 0.490162) < 1e-5 and abs(r[1] - 0.943318) < 1e-5


def test_auc_counts_ties_half(spark):
    d = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1)], "score double, y int")
    assert analysis.rank_auc(d).first()["auc"] == 0.875
