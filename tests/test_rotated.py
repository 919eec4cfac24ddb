"""The rotated index against exact searches, and its upkeep."""

import numpy as np
import pytest

from fieldqueue.operators import rotated, vectors


def made(spark, n=1500, d=16, seed=3):
    """Clusters whose spread lies along a few directions that no axis follows, so that a rotation has something to find."""
    r = np.random.default_rng(seed)
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((d, d)))[0]
    centres = np.random.default_rng(2).standard_normal((8, d))
    x = centres[r.integers(0, 8, n)] + (r.standard_normal((n, d)) * np.geomspace(2, 0.02, d)) @ turn
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), x / np.sqrt((x * x).sum(1))[:, None]


def cosines(index, books, x):
    got = rotated.reconstructed(index, books).toPandas()
    return (np.array(got.v.tolist()) * x[got.id]).sum(1)


def test_rotation_brings_decoded_vectors_nearer(spark):
    rows, x = made(spark)
    found = {}
    for rotate in (True, False):
        books = rotated.train(rows, 8, 4, 16, rotate=rotate)
        assert np.allclose(books.rotation @ books.rotation.T, np.eye(16), atol=1e-9)
        plain = rotated.Books(books.lists, books.rotation, books.parts, books.steps * 0, books.bits)
        index = rotated.encoded(rows, books).cache()
        found[rotate] = cosines(index, books, x).mean(), cosines(index, plain, x).mean()
    assert found[True][0] > 0.99 > found[True][1]  # refinement adds
    assert found[True][1] > found[False][1] + 0.005  # and so does rotation


def test_search_by_codes_alone(spark, monkeypatch):
    monkeypatch.setattr(rotated, "SPLIT", 40)
    rows, _ = made(spark)
    books = rotated.train(rows, 8, 8, 64)
    index = rotated.encoded(rows, books).cache()
    asked = rows.where("id % 25 = 0")
    got = rotated.search(index, asked, books, 5, 5, 100).toPandas()
    assert len(got) == 5 * asked.count() and not (got.id == got.nb).any()
    exact = vectors.exact_neighbours(asked, rows, 5).toPandas()
    assert len(got.merge(exact, on=["id", "nb"])) / len(exact) > 0.85
    few = rotated.search(index.where("id < 3"), asked.where("id < 60"), books, 5, 8, 100).toPandas()
    assert (few.nb[few.place > 3] == -1).all() and np.isneginf(few.cos[few.place > 3]).all() and (few.nb[few.place < 3] >= 0).all()


def test_rows_without_a_usable_vector_stay_out(spark):
    rows, _ = made(spark, 300)
    odd = spark.createDataFrame([(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (None, [1.0] * 16), (903, [None] * 16)], "id long, v array<double>")
    books = rotated.train(rows.unionByName(odd), 4, 4, 16)
    assert rotated.encoded(rows.unionByName(odd), books).count() == 300
    with pytest.raises(ValueError, match="don't divide"):
        rotated.train(rows, 4, 3)
    with pytest.raises(ValueError, match="no vectors"):
        rotated.train(odd, 4, 4)


def test_upkeep(spark):
    rows, x = made(spark, 1200)
    live = rows.select("id").where("id % 11 <> 0")
    books = rotated.train(rows.where("id < 900"), 8, 8, 64)
    index = rotated.build(rows.where("id < 900"), books, 4, 8, 200)
    index = rotated.apply(index, rows.where("id >= 880 and id < 1100"), live, 4, 8, 200)
    index = rotated.apply(index, rows.where("id >= 1100"), live, 4, 8, 200)
    parts = {r["part"]: r["n"] for r in index.rows.groupBy("part").agg({"id": "count"}).withColumnRenamed("count(id)", "n").collect()}
    new = [i for i in range(900, 1200) if i % 11]
    assert parts == {0: 900, 1: sum(i < 1100 for i in new), 2: sum(i >= 1100 for i in new)}
    # lists of the new rows are those of a whole build, but for rows that came later
    near = index.neighbours.where("part = 2").toPandas()
    there = np.array([i for i in range(1200) if i < 900 or i % 11])
    hits = total = 0
    for i, g in near.groupby("id"):
        s = x[there] @ x[i]
        s[there == i] = -9
        hits += len(set(there[np.argsort(-s)[:4]]) & set(g.nb))
        total += 4
        assert list(g.sort_values("place").place) == [1, 2, 3, 4] and g.cos.between(-1, 1).all() and i not in set(g.nb)
    assert hits / total > 0.85
    got = rotated.compacted(index, live)
    kept = {r["id"] for r in got.rows.collect()}
    assert kept == {i for i in range(1200) if i % 11} and {r["id"] for r in got.neighbours.collect()} == kept
    assert got.neighbours.count() == 4 * len(kept) and {r["part"] for r in got.rows.select("part").collect()} == {0}
    with pytest.raises(ValueError, match="would drop"):
        rotated.compacted(index, live.where("id < 700"))
    with pytest.raises(ValueError, match="2 vectors"):
        rotated.apply(index, rows.where("id = 7").unionByName(rows.where("id = 7")), live, 4, 8, 200)


def test_later_part_wins(spark):
    rows, x = made(spark, 300)
    books = rotated.train(rows, 4, 4, 32)
    code = rotated.encoded(rows, books)
    moved = rotated.encoded(rows.where("id = 5").selectExpr("id + 1 as id", "v"), books).selectExpr("*", "1 as part")
    both = code.selectExpr("*", "0 as part").unionByName(moved)
    got = {r["id"]: np.array(r["v"]) for r in rotated.reconstructed(both, books).collect()}
    assert len(got) == 300 and np.allclose(got[5], got[6])


def test_delta_of_nothing_and_into_nothing(spark):
    rows, _ = made(spark, 200)
    books = rotated.train(rows, 4, 4, 16)
    none = rotated.encoded(rows.limit(0), books)
    near = rotated.delta_neighbours(none, rows.where("id < 3"), books, 4, 4, 50).toPandas()
    assert len(near) == 12 and (near.nb[near.place > 2] == 0).all() and (near.cos[near.place > 2] == -1).all()
    assert rotated.delta_neighbours(rotated.encoded(rows, books), rows.limit(0), books, 4, 4, 50).count() == 0
