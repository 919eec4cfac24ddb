"""Fitted temperatures, tests of hypotheses and random bands against plain versions and known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldqueue.operators import hypotheses, temperature


def plain_fit(m, y, w):
    """Golden section over the logarithm of the temperature."""
    z = lambda u: (w * np.logaddexp(0, np.where(y > 0, m, -m) / math.exp(u))).sum()
    a, b, g = math.log(1e-4), 0.0, (math.sqrt(5) - 1) / 2
    for _ in range(200):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if z(c) < z(d) else (c, b)
    return math.exp((a + b) / 2)


def margins(spark, n=600, seed=1):
    r = np.random.default_rng(seed)
    cluster, m = r.integers(0, 40, n), np.round(r.uniform(-0.2, 0.2, n), 3)
    y = (r.random(n) < 1 / (1 + np.exp(m / 0.05))).astype(int)
    rows = [(int(c), float(a), int(b)) for c, a, b in zip(cluster, m, y)]
    return spark.createDataFrame(rows, "cluster long, margin double, y int").repartition(5), cluster, m, y


def test_temperature_is_the_optimum(spark):
    rows, cluster, m, y = margins(spark)
    f = temperature.fit(rows, reps=30, seed=4)
    assert f.n == 600 and f.temp == pytest.approx(plain_fit(m, y, np.ones(600)), rel=1e-6)
    assert f.loss == pytest.approx(np.logaddexp(0, np.where(y > 0, m, -m) / f.temp).mean()) and f.loss < temperature.loss(rows, 0.02)
    h = {r["cluster"]: r["h"] for r in rows.select("cluster", F.xxhash64("cluster").alias("h")).distinct().collect()}
    w = temperature.draws(np.array([h[c] for c in cluster.tolist()]), 30, 4)
    plain = [plain_fit(m, y, w[:, k]) for k in range(1, 31)]
    assert (f.low, f.high) == pytest.approx(tuple(np.percentile(plain, [2.5, 97.5])), rel=1e-5) and f.low < f.temp < f.high
    assert abs(temperature.draws(np.arange(20000), 3, 0)[:, 1:].mean() - 1) < 0.02


def test_temperatures_at_the_bounds_and_of_nothing(spark):
    s = "cluster long, margin double, y int"
    sure = spark.createDataFrame([(1, 0.5, 0), (2, -0.5, 1)] * 20, s)
    assert temperature.fit(sure).temp == pytest.approx(1e-4)
    against = spark.createDataFrame([(1, 0.5, 1), (2, -0.5, 0)] * 20, s)
    assert temperature.fit(against).temp == pytest.approx(1.0)
    odd = spark.createDataFrame([(None, None, 1), (None, 0.1, None), (1, float("nan"), 1)], s)
    assert temperature.fit(odd).temp is None and temperature.fit(odd).n == 0


@pytest.mark.parametrize("t,df", [(2.0, 10.0), (0.0, 5.0), (-1.5, 2.5), (12.706205, 1.0), (1.959964, 1e6), (9.0, 30.0)])
def test_known_values_of_t(spark, t, df):
    got = spark.range(1).select(hypotheses.two_sided(F.lit(t), F.lit(df))).first()[0]
    u = (np.arange(2_000_000) + 0.5) / 2_000_000 * (math.pi / 2)  # t = tan(u) sqrt(df)
    f = np.exp((df - 1) * np.log(np.cos(u)))
    assert got == pytest.approx(f[np.tan(u) * math.sqrt(df) >= abs(t)].sum() / f.sum(), rel=2e-3)
    if (t, df) == (12.706205, 1.0):
        assert got == pytest.approx(0.05, rel=1e-6)


def test_incomplete_beta_against_integrals(spark):
    for x, a, b in ((0.3, 2.0, 5.0), (0.9, 0.5, 0.5), (0.05, 30.0, 2.0), (0.999, 8.0, 0.5), (0.5, 200.0, 190.0)):
        u = (np.arange(400_000) + 0.5) / 400_000 * (math.pi / 2)  # x = sin(u) ** 2 smooths the ends
        f = np.sin(u) ** (2 * a - 1) * np.cos(u) ** (2 * b - 1)
        want = f[np.sin(u) ** 2 <= x].sum() / f.sum()
        got = spark.range(1).select(hypotheses.incomplete_beta(F.lit(x), F.lit(a), F.lit(b))).first()[0]
        assert got == pytest.approx(want, abs=2e-5)


def ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_rank_correlation_and_welch(spark):
    r = np.random.default_rng(3)
    x, y = r.integers(0, 6, 300), r.integers(0, 3, 300)
    y = np.where(r.random(300) < 0.2, x // 2, y)
    d = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)] + [(None, 1), (2, None)], "x int, y int")
    got = hypotheses.spearman(d, "x", "y").first()
    assert got["n"] == 300 and got["rho"] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    assert 0.5 < got["p"] < 1 if got["rho"] > 0 else got["p"] < 0.5
    down = hypotheses.spearman(spark.createDataFrame([(i, -i) for i in range(9)], "x int, y int"), "x", "y").first()
    assert down["rho"] == -1 and down["p"] == 0
    assert hypotheses.spearman(spark.createDataFrame([(i, 1) for i in range(9)], "x int, y int"), "x", "y").first()["rho"] is None
    a, b = r.normal(0, 1, 40), r.normal(0.4, 3, 25)
    g = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "grp string, value double")
    w = hypotheses.welch(g, "a", "b").first()
    va, vb = a.var(ddof=1) / 40, b.var(ddof=1) / 25
    assert w["t"] == pytest.approx((a.mean() - b.mean()) / math.sqrt(va + vb)) and w["df"] == pytest.approx((va + vb) ** 2 / (va**2 / 39 + vb**2 / 24))
    same = hypotheses.welch(g.withColumn("value", F.lit(1.0)), "a", "b").first()
    assert same["p"] == 1.0 and hypotheses.welch(g, "a", "none").first()["p"] is None


def reviewed(n=800, seed=5):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        source = "cv" if i % 2 else "typed"
        wrong = int(r.random() < (0.3 if source == "cv" else 0.2))
        over = int(wrong and r.random() < (0.3 if source == "cv" else 0.8))
        rows.append((i, source, wrong, over, float(r.integers(1, 5)) / 4, f"g{i % 3}"))
    return rows


def test_detection_and_its_interval(spark):
    rows = reviewed()
    d = spark.createDataFrame(rows, "record long, source string, wrong int, over int, complete double, grp string").repartition(4)
    got = {(r["grp"], r["source"]): r for r in hypotheses.detection(d, "grp", reps=400, seed=2, c=0.05, c_n=50, nowcast=True).collect()}
    assert set(got) == {(g, s) for g in ("g0", "g1", "g2", "all") for s in ("cv", "typed")}
    for (g, s), r in got.items():
        own = [x for x in rows if x[1] == s and g in (x[5], "all")]
        e = (np.mean([x[2] for x in own]) - 0.05) / 0.9
        o = sum(x[3] for x in own) / sum(x[4] for x in own)
        assert r["n"] == len(own) and (r["error"], r["overturned"], r["detected"]) == pytest.approx((e, o, o / e))
        assert r["low"] < r["detected"] < r["high"]
    # drawing how often each distinct row comes is drawing records: same spread as a plain bootstrap
    own = np.array([x[2:4] for x in rows if x[1] == "cv"])
    rng = np.random.default_rng(0)
    plain = [(lambda s: s[:, 1].mean() / s[:, 0].mean())(own[rng.integers(0, len(own), len(own))]) for _ in range(2000)]
    r = hypotheses.detection(d, "grp", reps=2000).where("grp = 'all' and source = 'cv'").first()
    assert (r["low"], r["high"]) == pytest.approx(tuple(np.percentile(plain, [2.5, 97.5])), abs=0.03)
    none = hypotheses.detection(d.withColumn("wrong", F.lit(0)), "grp", reps=10).first()
    assert none["detected"] is None and none["low"] is None


def test_hypotheses_of_a_clear_difference(spark):
    rows = reviewed(2000)
    cons = spark.createDataFrame([(i, "t", 0.95 if i % 5 > i % 4 else 0.5) for i, *_ in rows], "record long, label string, posterior double")
    firsts = spark.createDataFrame([(i, s, "u" if w else "t") for i, s, w, *_ in rows], "record long, source string, first string")
    public = spark.createDataFrame([(i, "x" if o else ("u" if w else "t")) for i, _, w, o, *_ in rows], "record long, public string")
    levels = spark.createDataFrame([(i, i % 4) for i, *_ in rows], "record long, level int")
    got = {r["test"]: r for r in hypotheses.hypotheses(cons, firsts, public, levels, ("cv", "typed"), reps=500).collect()}
    assert got["error"]["statistic"] > 0 and got["error"]["p"] < 0.1
    assert got["detection"]["statistic"] < -0.2 and got["detection"]["p"] < 0.02
    assert got["levels"]["statistic"] < -0.3 and got["levels"]["p"] < 1e-6
    one = {r["test"] for r in hypotheses.hypotheses(cons, firsts.where("source = 'cv'"), public, levels.withColumn("level", F.lit(1)), ("cv", "typed")).collect()}
    assert one == set()


def test_bands_are_those_of_whole_random_orders(spark, monkeypatch):
    d = spark.range(700).selectExpr("id", "id % 3 = 0 as a", "id % 7 = 0 as b").repartition(3)
    got = {(r["k"], r["outcome"]): (r["low"], r["mid"], r["high"]) for r in hypotheses.random_bands(d, ["a", "b"], [5, 60, 5000], reps=25, seed=8).collect()}
    u = {(i, rep): hashed(8, rep, i) for rep in range(1, 26) for i in range(700)}
    for k in (5, 60, 5000):
        for name, mod in (("a", 3), ("b", 7)):
            each = [np.mean([i % mod == 0 for i in sorted(range(700), key=lambda i: (u[i, rep], i))[:k]]) for rep in range(1, 26)]
            assert got[k, name] == pytest.approx(tuple(np.percentile(each, [2.5, 50, 97.5])))


def hashed(seed, rep, i):
    import hashlib

    return int(hashlib.md5(f"{seed}:{rep}:{i}".encode()).hexdigest()[:13], 16) / 2**52
