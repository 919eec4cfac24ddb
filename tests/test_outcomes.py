"""Tables by level, cohorts, quantiles and novelty against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldqueue.operators import outcomes


def test_cohorts_tell_corrections_from_renamed_taxa(spark):
    rows = [(1, "easy", 10, "a b"), (2, "easy", 10, "a b"), (3, "easy", 11, "a b"), (4, "weird", 12, "c d"), (5, "weird", 10, None), (6, "weird", 10, "a b"), (7, "easy", 10, "a b")]
    leveled = spark.createDataFrame(rows, "id long, level string, taxon_id long, other_name string")
    after = spark.createDataFrame([(1, 10, "x y"), (2, 20, "a b"), (3, 21, "a b"), (5, 22, "a z"), (6, 23, "a z"), (7, 20, "q r"), (7, 20, "q r")], "id long, taxon_id long, name string")
    left = spark.createDataFrame([(4, 99), (4, 99)], "id long, taxon_id long")
    got = {r["id"]: tuple(r)[4:] for r in outcomes.cohort(leveled, after, leveled.where("id = 7"), left).collect()}
    # left, corrected, changed_any, to_suggested, to_suggested_genus
    assert got == {1: (False, False, False, False, False), 2: (False, True, True, True, True), 3: (False, False, False, False, False), 4: (True, False, False, False, False), 5: (False, True, True, False, False), 6: (False, True, True, False, True)}
    assert "changed_any" not in outcomes.cohort(leveled, after).columns


def test_quantiles_of_groups_of_any_size(spark):
    r = np.random.default_rng(3)
    x = {"hot": r.normal(0, 1, 4000), "few": r.normal(0, 1, 3), "one": np.array([2.5])}
    d = spark.createDataFrame([(k, float(v)) for k, vs in x.items() for v in vs] + [("hot", None)], "g string, v double").repartition(6)
    qs = [0.0, 0.02, 0.5, 0.9, 1.0]
    got = {(q["g"], q["q"]): q["value"] for q in outcomes.quantiles(d, ["g"], "v", qs).collect()}
    assert set(got) == {(k, q) for k in x for q in qs}
    for (k, q), v in got.items():
        assert v == pytest.approx(np.quantile(x[k], q))


@pytest.mark.parametrize("block", [7, 4096])
def test_novelty_in_blocks(spark, block):
    r = np.random.default_rng(4)
    v, w = r.standard_normal((60, 5)), r.standard_normal((40, 5))
    pool = spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in enumerate(v)], "id long, grp long, v array<double>")
    ref = spark.createDataFrame([(i % 2, x.tolist()) for i, x in enumerate(w)], "grp long, v array<double>")
    got = {q["id"]: q["cos"] for q in outcomes.nearest_reference(pool, ref, block).collect()}
    unit = lambda x: x / np.sqrt((x * x).sum(-1, keepdims=True))
    for i in range(60):
        if i % 3 == 2:
            assert i not in got
        else:
            assert got[i] == pytest.approx((unit(w[i % 3 :: 2]) @ unit(v[i])).max())
    d = pool.withColumn("created_at", F.timestamp_seconds(F.col("id") % 5)).withColumn("v", F.when(F.col("id") % 10 != 0, F.col("v")))
    order = [q["id"] for q in outcomes.novelty_order(d, ref).where("grp = 0").orderBy("place").collect()]
    own = [i for i in range(0, 60, 3)]
    want = sorted(own, key=lambda i: (i % 10 == 0, -round(max(0, 1 - got[i]), 9) if i % 10 else 0, -(i % 5), -i))
    assert order == want
    assert [q["id"] for q in outcomes.novelty_order(d, ref).where("grp = 2").orderBy("place").collect()] == sorted(range(2, 60, 3), key=lambda i: (-(i % 5), -i))


def test_empty_tables_give_no_levels(spark):
    none = spark.createDataFrame([], "record long, label string, posterior double")
    counts, levels = spark.createDataFrame([], "record long, n_answers long, n_abstain long"), spark.createDataFrame([], "record long, level string")
    assert outcomes.level_table(none, counts, levels).count() == 0
    assert outcomes.evidence_counts(spark.createDataFrame([], "food string, text string, comments int, grade string")).first()["obs"] == 0
    assert outcomes.separability(spark.createDataFrame([], "id long, label string, v array<double>")).first()["n"] == 0


def test_kept_tables_are_forgotten_and_others_left(spark, tmp_path):
    import os

    from fieldqueue.sources.shared import forget, kept

    other = f"{tmp_path}/mine"
    spark.range(5).write.parquet(other)
    table, mine = kept(spark.range(7)), spark.read.parquet(other)
    folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert table.count() == 7 and os.path.isdir(folder)
    forget(table)
    forget(mine)
    forget(kept(spark.range(0)))
    assert not os.path.exists(folder) and mine.count() == 5
