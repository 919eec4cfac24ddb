"""Queries of the vector index, its upkeep, and of grown batches; exact searches and tests hold what SQL can't express."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldqueue.operators import index, rotated
from fieldqueue.plans.similarity import neighbours, rows

#: Lists, parts and codes of the codebooks; neighbours, lists looked into and rows refined in each.
BOOKS, SEARCH = (16, 8, 64), (5, 12, 200)


def books(s, d):
    return rotated.train(rows(s, d), *BOOKS)


def trained(s, d):
    """How many rows of the table each list gets, and the rows' mean cosine to the list's centre."""
    r, b = rows(s, d), books(s, d)
    centres = F.broadcast(s.createDataFrame([(i, c.tolist()) for i, c in enumerate(b.lists)], "list int, c array<double>"))  # the codebook
    j = rotated.encoded(r, b).select("id", "list").join(r, "id").join(centres, "list")
    return j.groupBy("list").agg(F.count("*").alias("n"), F.round(F.avg(index.cosine(F.col("v"), F.col("c"))), 4).alias("cos"))


def encode(s, d):
    return rotated.encoded(rows(s, d), books(s, d)).select("id", "list", F.hex("codes").alias("codes"), F.hex("refine").alias("refine"))


def search(s, d):
    b = books(s, d)
    found = rotated.search(rotated.encoded(rows(s, d), b), rows(s, d).where("id % 10 = 0"), b, *SEARCH)
    return found.select("id", "place", "nb", F.round("cos", 6).alias("cos"))


def reconstruct(s, d):
    """Cosine of every vector to what its codes decode to."""
    b = books(s, d)
    back = rotated.reconstructed(rotated.encoded(rows(s, d), b), b).withColumnRenamed("v", "back")
    return back.join(rows(s, d), "id").select("id", F.round(index.cosine(F.col("v"), F.col("back")), 6).alias("cos"))


def recall(s, d):
    """Share of the exact five neighbours that the index finds."""
    b = search(s, d).groupBy("id").agg(F.collect_set("nb").alias("b"))
    a = neighbours(s, d).groupBy("id").agg(F.collect_set("nb").alias("a"))
    return a.join(b, "id").agg(F.round(F.avg(F.size(F.array_intersect("a", "b")) / 5), 6).alias("recall"))


def new_part(s, d):
    """An index of four fifths of the rows to which all rows that are live come."""
    r = rows(s, d)
    b = rotated.train(r.where("id % 5 <> 0"), *BOOKS)
    old = rotated.build(r.where("id % 5 <> 0"), b, *SEARCH)
    live = r.select("id").where("id % 7 <> 3")
    return rotated.apply(old, r, live, *SEARCH), live


def applied(s, d):
    return new_part(s, d)[0].rows.select("id", "part")


def delta(s, d):
    found = new_part(s, d)[0].neighbours.where("part = 1")
    return found.select("id", "place", "nb", F.round("cos", 6).alias("cos"))


def compacted(s, d):
    """Ids and lengths of the neighbour lists after a compaction."""
    got = rotated.compacted(*new_part(s, d))
    n = got.neighbours.groupBy("id").agg(F.count("*").alias("neighbours"))
    return got.rows.select("id", "part").join(n, "id")


def similarity(s, d):
    r = rows(s, d).withColumn("score", (F.col("id") % 101) / 101)
    return index.similarity_order(r, "label", 10)


QUERIES = {
    "ivf_train": trained,
    "ivf_encode": encode,
    "ivf_reconstruct": reconstruct,
    "knn_ivf_search": search,
    "recall_at_k": recall,
    "delta_nn": delta,
    "index_apply": applied,
    "index_compacted": compacted,
    "order_similarity": similarity,
}
ORACLE = {
    "index_apply": "select vec_id id, case when vec_id % 5 <> 0 then 0 else 1 end part from embeddings where vec_id % 5 <> 0 or vec_id % 7 <> 3",
    "index_compacted": "select vec_id id, 0 part, least(5, (select count(*) from embeddings) - 1)::BIGINT neighbours from embeddings where vec_id % 7 <> 3",
}
