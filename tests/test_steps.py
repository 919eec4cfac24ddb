import math

import numpy as np
import pytest

from fieldqueue.operators import batches, ordering, overturn, state, vectors
from fieldqueue.plans import steps
from fieldqueue.sources import tables

T = "timestamp'2026-01-01'"


def test_ranked_equals_one_window_with_hot_group_and_nulls(spark):
    df = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then null when id % 50 = 1 then 'rare' else 'hot' end g", "id * 7919 % 1000 x")
    got = {r["id"]: (r["place"], r["m"]) for r in ordering.ranked(df, ["g"], [ordering.F.col("x").desc(), ordering.F.col("id").asc()], "place", "m").collect()}
    rows = [(r["g"], -r["x"], r["id"]) for r in df.collect()]
    for g in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == g)
        assert [got[i] for _, i in own] == [(k, len(own)) for k in range(len(own))]
    assert ordering.ranked(df.limit(0), ["g"], [ordering.F.col("x").asc()]).count() == 0


def test_group_quantile_is_linear(spark):
    df = spark.createDataFrame([(i, "a", float(i)) for i in range(10)] + [(20, "b", 5.0), (21, "c", None)], "id long, g string, x double")
    got = {r["g"]: r["cut"] for r in ordering.group_quantile(df, "g", "x", 0.75).collect()}
    assert got == {"a": pytest.approx(6.75), "b": 5.0}


def test_stratified_deal_shares_and_refusals(spark):
    pool = spark.range(301).selectExpr("id", "case when id < 250 then 'x' else 'y' end stratum")
    n = {}
    for r in batches.deal_stratified(pool, ["a", "b", "c"], 1).collect():
        n[r["stratum"], r["arm"]] = n.get((r["stratum"], r["arm"]), 0) + 1
    for s in "xy":
        own = [n[s, a] for a in "abc"]
        assert max(own) - min(own) <= 1
    for arms in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            batches.deal_stratified(pool, arms, 1)


LOG = "build_date string, label string, id long"


def test_served_log_replaces_a_day_and_refuses_a_changed_label(spark):
    log = spark.createDataFrame([("d1", "A", 1), ("d1", "B", 2), ("d2", "A", 3)], LOG)
    got = state.append_served(log, spark.createDataFrame([("d2", "A", 1), ("d2", "B", 4)], LOG)).collect()
    assert sorted(map(tuple, got)) == [("d1", "A", 1), ("d1", "B", 2), ("d2", "A", 1), ("d2", "B", 4)]
    with pytest.raises(Exception, match="changed its label"):
        state.append_served(log, spark.createDataFrame([("d2", "B", 1)], LOG)).collect()


def test_index_parts_clash_and_compact(spark):
    index = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5), ("b", 2, 0.7)], "part string, id long, x double")
    assert sorted(map(tuple, state.compact(index, spark.createDataFrame([(2,), (9,)], "id long")).select("part", "id", "x").collect())) == [("base", 2, 0.7)]
    with pytest.raises(Exception, match="already"):
        state.append_part(index, spark.createDataFrame([(2, 0.1)], "id long, x double"), "c").collect()


def test_sources_name_missing_columns_and_cast(spark):
    df = spark.createDataFrame([("1", "x")], "id string, a string")
    with pytest.raises(ValueError, match="b"):
        tables.checked(df, ["id", "b"])
    assert tables.framed(df, "id long, b double").dtypes == [("id", "bigint"), ("b", "double")]
    with pytest.raises(ValueError):
        steps.half_open(df, "2026-02-01", "2026-01-01")


def test_a_log_is_held_against_the_build_repeated_from_its_record(spark):
    pool = spark.range(900).selectExpr("id", "string(id % 2) as grp", "timestamp_seconds(id * 977 % 10000) as created_at")
    record = state.recorded(pool, b"k", {"size": 10, "most": 20})
    log = steps.rebuilt(pool, b"k", 10, 20).cache()
    assert state.replay(record, log, pool.repartition(7), b"k", steps.rebuilt).count() == 0
    lost = log.where("id <> 5").unionByName(log.where("id = 6"))
    assert sorted((r["side"], r["id"]) for r in state.replay(record, lost, pool, b"k", steps.rebuilt).collect()) == [("expected", 6), ("rebuilt", 5)]
    with pytest.raises(state.ReplayError, match="pool"):
        state.replay(record, log, pool.where("id <> 3"), b"k", steps.rebuilt)
    with pytest.raises(state.ReplayError, match="key"):
        state.replay(record, log, pool, b"other", steps.rebuilt)
    assert state.replay(state.recorded(pool, b"k", {"size": 9, "most": 20}), log, pool, b"k", steps.rebuilt).count() > 0


def test_clades_in_blocks_of_classes(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(5)
    means, x = r.standard_normal((23, 6)), r.standard_normal((40, 6))
    unit = lambda v: v / np.sqrt((v * v).sum(-1, keepdims=True))
    spans = [(int(a), int(a + w)) for a, w in zip(r.integers(0, 20, 40), r.integers(0, 9, 40))] + [(30, 40), (0, 22)]
    x = np.concatenate([x, x[:2]])
    records = spark.createDataFrame([(i, v.tolist(), *spans[i]) for i, v in enumerate(x)], "id long, v array<double>, lo long, hi long")
    classes = spark.createDataFrame([(f"s{i}", i, (3 * m).tolist()) for i, m in enumerate(means)], "label string, at long, total array<double>")
    want = {}
    for i, (a, b) in enumerate(spans):
        s = np.round(unit(x[i]) @ unit(means).T, 9)
        order = sorted(range(a, min(b, 22) + 1), key=lambda j: (-s[j], j))
        if order:
            out = [v for j, v in enumerate(s) if not a <= j <= b]
            want[i] = (s[order[0]], f"s{order[0]}", *((s[order[1]], f"s{order[1]}") if len(order) > 1 else (None, None)), max(out) if out else None)
    for block in (4, 4096):
        monkeypatch.setattr(vectors, "CLASSES", block)
        got = {q["id"]: tuple(q)[1:] for q in vectors.clade_scores(records, classes).collect()}
        assert set(got) == set(want)
        for i, w in want.items():
            assert got[i] == pytest.approx(w) if None not in w else got[i] == w


def test_first_identifications_and_overturn(spark):
    i = "id long, seq long, own boolean, current boolean, vision boolean, created_at timestamp, taxon string, anc array<string>, rank string, user_idents long"
    rows = [
        (1, True, True, "s1", "species"), (1, False, None, "s1", "species"),  # upheld
        (2, True, False, "s1", "species"), (2, False, None, "s2", "species"), (2, False, None, "s2", "species"),  # overturned
        (3, True, True, "s1", "species"), (3, False, None, "sub", "subspecies"),  # refined
        (4, True, True, "s1", "species"), (4, False, None, "s2", "species"),  # no community taxon: tested, not overturned
        (5, True, True, "g", "genus"), (5, False, None, "s2", "species"),  # a genus isn't tested
    ]
    anc = {"s1": ["g"], "s2": ["g"], "sub": ["g", "s1"], "g": []}
    import datetime

    at = datetime.datetime(2026, 1, 1)
    idents = spark.createDataFrame([(r, k, own, True, vision, at + datetime.timedelta(hours=k), t, anc[t], rank, 5) for k, (r, own, vision, t, rank) in enumerate(rows)], i)
    ct = {1: "s1", 2: "s2", 3: "sub", 4: None, 5: "s2"}
    records = spark.createDataFrame([(k, None, "needs_id", c, at, None) for k, c in ct.items()], "id long, grp string, quality string, ct string, created_at timestamp, observer_idents long")
    got = {r["id"]: (r["source"], r["tested"], r["overturned"]) for r in overturn.scored(records, idents).collect()}
    assert got == {1: ("cv", True, False), 2: ("typed", True, True), 3: ("cv", True, False), 4: ("cv", True, False), 5: ("cv", False, False)}
    same = {(r["id"], r["seq"]): r["same"] for r in overturn.other_ids(overturn.scored(records, idents), idents).collect()}
    assert same == {(1, 1): True, (2, 3): False, (2, 4): False, (3, 6): True, (4, 8): False}


def test_class_scores_in_blocks_of_few_classes(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, i % 7, r.standard_normal(6).tolist()) for i in range(60)] + [(100, 50, [1.0] * 6)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    whole = {x["id"]: x for x in vectors.prototype_scores(df).collect()}
    monkeypatch.setattr(vectors, "CLASSES", 2)
    for x in vectors.prototype_scores(df).collect():
        assert x["other_label"] == whole[x["id"]]["other_label"] and x["other"] == pytest.approx(whole[x["id"]]["other"]) and x["own"] == (whole[x["id"]]["own"] and pytest.approx(whole[x["id"]]["own"]))
    u = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    for i, label, _ in rows:
        total = lambda k: sum(u[j] for j, m, _ in rows if m == k and j != i)
        cos = {k: float(u[i] @ total(k) / np.linalg.norm(total(k))) for k in range(7)}
        best = max((k for k in range(7) if k != label), key=lambda k: cos[k])
        assert whole[i]["other_label"] == best and math.isclose(whole[i]["other"], cos[best], rel_tol=1e-9)
        assert (whole[i]["own"] is None) == (label == 50) and (label == 50 or math.isclose(whole[i]["own"], cos[label], rel_tol=1e-9))
