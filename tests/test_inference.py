import math
from itertools import combinations, product

import pytest

from fieldqueue.operators import inference, tree


def p_of(spark, d, **kw):
    return inference.sign_flip(spark.createDataFrame([("a", float(x)) for x in d], "arm string, d double"), ["arm"], kw.pop("reps", 2000), 3, **kw).first()


def test_sign_flip_tries_all_signs_of_few_and_draws_for_many(spark):
    d = [3.0, -1.0, 2.0, 2.0, 0.0, 0.5]
    sums = [sum(s * x for s, x in zip(signs, d[:4] + d[5:])) for signs in product((-1, 1), repeat=5)]
    assert p_of(spark, d)["p"] == pytest.approx(sum(abs(s) >= 6.5 for s in sums) / 32)
    assert p_of(spark, d, greater=True)["p"] == pytest.approx(sum(s >= 6.5 for s in sums) / 32)
    assert p_of(spark, [0.0, 0.0])["p"] == 1
    many = [1.0] * 100 + [-1.0] * 70 + [2.0] * 5
    n = 20_000
    ways = lambda k, m: math.comb(m, k) / 2**m
    want = sum(ways(i, 170) * ways(j, 5) for i in range(171) for j in range(6) if abs(2 * i - 170 + 2 * (2 * j - 5)) >= 40)
    got = p_of(spark, many, reps=n)
    assert got["total"] == 40 and abs(got["p"] - want) < 5 * math.sqrt(want / n)


def test_sign_test_is_exact(spark):
    rows = [(7, 1), (0, 0), (5, 5), (0, 9), (900, 1000), (1, 3000)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, b long").select(inference.sign_test(*map(__import__("pyspark").sql.functions.col, "ab"))).collect()]
    for (a, b), p in zip(rows, got):
        n, m = a + b, min(a, b)
        assert math.isclose(p, min(1.0, 2 * sum(math.comb(n, i) for i in range(m + 1)) / 2**n) if n else 1.0, rel_tol=1e-6, abs_tol=1e-300)


def test_record_shuffle_permutes_within_strata_only(spark):
    rows = [(1, "t", "x", 3), (2, "t", "x", 0), (3, "c", "x", 1), (4, "c", "x", 0), (5, "t", "y", 2), (6, "c", "y", 2), (7, "other", "y", 50)]
    t = spark.createDataFrame(rows, "id long, arm string, s string, n long")
    n, hits, ways = [3, 0, 1, 0], 0, 0
    for mine in combinations(range(4), 2):
        for last in (0, 0):  # either of two equal records
            s = 2 * sum(n[i] for i in mine) - 4 + last
            hits, ways = hits + (s >= 2), ways + 1
    got = inference.record_shuffle(t, "t", "c", 4000, 1, greater=True, strata="s").first()
    assert got["total"] == 2 and abs(got["p"] - hits / ways) < 0.04
    # a stratum of one list alone can't move
    alone = spark.createDataFrame([(1, "t", "x", 5), (2, "c", "y", 1)], "id long, arm string, s string, n long")
    assert inference.record_shuffle(alone, "t", "c", 50, 1, strata="s").first()["p"] == 1
    assert inference.record_shuffle(alone, "t", "c", 50, 1, greater=True).first()["p"] == pytest.approx(0.5)


COUNTS = [(1, 3, 1, 0), (2, 2, 0, 1), (3, 1, 1, 1), (4, 5, 2, 0)]


def counts(spark):
    return spark.createDataFrame(COUNTS, "user_id long, t long, u long, control long")


def test_analyse_rows_and_adjustment(spark):
    got = {r["arm"]: r for r in inference.analyse(counts(spark), ["control", "t", "u"], "control", 100, 1).collect()}
    assert got["t"]["total"] == 11 and got["t"]["total_control"] == 2 and got["t"]["n_identifiers"] == 4 and got["t"]["mean_diff"] == 9 / 4
    assert got["t"]["p"] == pytest.approx(0.25) and got["t"]["p_sign"] == pytest.approx(0.25)  # three differences above 0
    small, large = sorted(got.values(), key=lambda r: (r["p"], r["arm"]))
    assert small["p_holm"] == pytest.approx(min(1, 2 * small["p"])) and large["p_holm"] == pytest.approx(max(small["p_holm"], large["p"]))
    with pytest.raises(ValueError):
        inference.analyse(counts(spark), ["t", "u"], "control")


def test_ratio_interval_exact_ordered_and_seeded(spark):
    one = lambda: {r["arm"]: r for r in inference.ratio_interval(counts(spark), ["control", "t", "u"], "control", 500, 2).collect()}
    got = one()
    assert got["t"]["ratio"] == 5.5 and got["t"]["ratio_lo"] <= 5.5 <= got["t"]["ratio_hi"] and got == one()
    none = counts(spark).selectExpr("user_id", "t", "u", "0L as control")
    assert [r["ratio"] for r in inference.ratio_interval(none, ["control", "t", "u"], "control").collect()] == [None, None]


def test_confirmatory_roles_and_family(spark):
    totals = spark.createDataFrame([(i, "t" if i % 2 else "control", float(i % 3)) for i in range(20)] + [(30, "u", 1.0)], "id long, arm string, n double")
    both = {"plain": (counts(spark), totals), "weighted": (counts(spark), totals)}
    got = {(r["arm"], r["outcome"]): r for r in inference.confirmatory(both, ["control", "t", "u"], "control", {"t": "plain", "u": "weighted"}, ["t"], 200, 1).collect()}
    assert {k: r["role"] for k, r in got.items()} == {("t", "plain"): "primary", ("t", "weighted"): "secondary", ("u", "plain"): "secondary", ("u", "weighted"): "exploratory"}
    assert got["t", "plain"]["p_holm"] == got["t", "plain"]["p"] and got["u", "weighted"]["p_holm"] is None
    with pytest.raises(ValueError):
        inference.confirmatory(both, ["control", "t", "u"], "control", {"t": "plain"}, ["t"])


@pytest.mark.parametrize(
    "votes, want",
    [
        ([["a", "a1"], ["a", "a1"]], ("a1", 1.0)),
        ([["a", "a1"]], None),
        ([["g", "s1"], ["g", "s2"]], ("g", 1.0)),
        ([["a", "a1"], ["a", "a1"], ["b"]], None),  # two of three are not above two thirds
        ([["a", "a1"], ["a", "a1"], ["a"]], ("a1", 1.0)),  # a vote for an ancestor isn't against
        ([["a", "a1"]] * 3 + [["b"]], ("a1", 0.75)),
        ([["a", "a1"]] * 3 + [["a", "a2"]], ("a1", 0.75)),
    ],
)
def test_community_vote(spark, votes, want):
    got = tree.community(spark.createDataFrame([(1, v) for v in votes], "id long, path array<string>")).collect()
    assert [(r["node"], r["score"]) for r in got] == ([want] if want else [])


def test_lineages_have_no_depth_limit(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(50)] + [(100, 101), (101, 100)], "id long, parent long")
    got = {r["id"]: r["path"] for r in tree.lineages(nodes).collect()}
    assert set(got) == set(range(50)) and got[49] == list(range(50))
