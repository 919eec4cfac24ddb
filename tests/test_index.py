import numpy as np

from fieldqueue.operators import index


def clustered(spark, n=1500, d=16):
    r = np.random.default_rng(3)
    centres = r.standard_normal((12, d)) * 2
    x = centres[r.integers(0, 12, n)] + r.standard_normal((n, d)) * 0.5
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), x


def test_similarity_order_places_every_row(spark, monkeypatch):
    monkeypatch.setattr(index, "CELL", 150)
    rows, _ = clustered(spark, 1200)
    d = rows.selectExpr("id", "v", "if(id < 1000, 'g', 'h') as grp", "double(id % 7) as score")
    same = spark.sql("select 5000 + id as id, array_repeat(1.0D, 16) as v, 'g' as grp, cast(null as double) as score from range(600)")
    none = spark.sql("select 9000 + id as id, if(id = 0, array_repeat(0.0D, 16), null) as v, if(id < 13, 'g', null) as grp, 1.0D as score from range(15)")
    got = index.similarity_order(d.unionByName(same).unionByName(none), "grp", 20).toPandas()
    assert sorted(got.id) == [*range(1200), *range(5000, 5600), *range(9000, 9015)]
    assert not got.duplicated(["grp", "batch", "place"]).any()
    g = got[got.grp == "g"].sort_values(["batch", "place"])
    assert g.groupby("batch").size().max() == 20 and list(g.batch.unique()) == list(range(g.batch.max() + 1))
    assert list(g.id[-13:]) == list(range(9012, 8999, -1)) and list(got[got.grp.isna()].sort_values("place").id) == [9014, 9013]
    h = got[got.grp == "h"]
    mean = (h.id % 7).groupby(h.batch).mean().to_numpy()
    assert (mean[1:] <= mean[:-1] + 1e-9).all()
