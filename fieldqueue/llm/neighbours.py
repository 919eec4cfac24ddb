"""Approximate nearest neighbours by a forest of sorted hash strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldqueue.llm.lean import lean
from fieldqueue.llm.shared import kept

#: Trees, bits of a hash string; matches in all trees together at which a query's first ascent ends; probability with which a row as near as the k-th found may be missed.
TREES, BITS, FIRST, MISS = 32, 32, 2048, 0.1
#: Rows of a block that one task reads at a time, about.
BLOCK = 8192
SEED = 20240517


@lean
def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, u, strings) of rows (vec_id, v): the unit vector in single precision and a hash string for each tree: the sides of BITS random hyperplanes, first plane first."""
    planes: dict[int, np.ndarray] = {}
    weight = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    for batch in batches:
        rows = batch.column(1).to_pylist()
        out, units = np.zeros((len(rows), TREES), np.int64), [None] * len(rows)
        size = np.array([len(r) for r in rows])
        for d in np.unique(size).tolist():
            if d not in planes:
                planes[d] = np.random.default_rng([SEED, d]).standard_normal((d, TREES * BITS))
            which = np.flatnonzero(size == d)
            x = np.array([rows[i] for i in which], np.float64)
            x = x / np.abs(x).max(1, keepdims=True)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            out[which] = (x @ planes[d] > 0).reshape(len(which), TREES, BITS) @ weight
            for i, u in zip(which.tolist(), x.astype(np.float32)):
                units[i] = u
        cols = [batch.column(0), pa.array(units, pa.list_(pa.float32())), pa.array(out.tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["vec_id", "u", "strings"])


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two matrices in double precision; equal rows get equal values wherever they stand."""
    q, x = q / np.abs(q).max(1, keepdims=True), x / np.abs(x).max(1, keepdims=True)
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum(1)))


@lean
def rescored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score) of rows (query_id, vec_id, q, v): the cosine of the two original vectors."""
    for batch in batches:
        out = np.zeros(batch.num_rows)
        q, v = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        size = np.array([len(r) for r in v])
        for d in np.unique(size).tolist():
            which = np.flatnonzero(size == d).tolist()
            out[which] = cosines(np.array([q[i] for i in which]), np.array([v[i] for i in which]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["query_id", "vec_id", "score"])


@lean
def prefix_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, level, n): how many rows of its block share a prefix of each length with a query, from rows (tree, block, part, query, vec_id, string, bits) sorted by block."""
    now, held, bits = None, [], 0

    def found() -> pa.RecordBatch:
        query, ids, string = (np.concatenate(x) for x in zip(*held))
        data, levels = np.sort(string[~query]), np.arange(bits, BITS + 1)
        width = np.int64(1) << (BITS - levels)
        low = string[query][:, None] // width * width
        n = np.searchsorted(data, low + width) - np.searchsorted(data, low)
        some = n > 0
        who, which = np.nonzero(some)
        return pa.RecordBatch.from_arrays([pa.array(ids[query][who]), pa.array(levels[which].astype(np.int32)), pa.array(n[some])], ["query_id", "level", "n"])

    for batch in batches:
        tree, block, part, query, ids, string, depth = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        key = np.stack([tree, block, part])
        edge = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [len(tree)])) if len(tree) else [0]
        for i, j in zip(edge[:-1], edge[1:]):
            own = tuple(key[:, i].tolist())
            if own != now:
                if held:
                    yield found()
                now, held, bits = own, [], int(depth[i])
            held.append((query[i:j].astype(bool), ids[i:j], string[i:j]))
    if held:
        yield found()


def slack(d: int) -> float:
    """What single precision may be off by in a product of unit vectors."""
    return 1e-6 * max(16, d)


def block_matches(k: int):
    """From rows (tree, block, part, asks, vec_id, u, string, earlier, ends) that are sorted so, a block's rows before its queries: (query_id, vec_id, approx, n) of the k nearest of those that share the first `ends` bits with a query in this tree and in none before it, with what single precision may have put just below; and a row without vec_id that counts all n of them.

    Only the rows of one block stand in memory; queries pass by.
    """

    def lists(column: pa.Array, kind: type) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1) if len(column.flatten()) else np.zeros((len(column), 0), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, data = None, [], None
        for batch in batches:
            asks = np.asarray(batch.column("asks"))
            key = np.stack([*(np.asarray(batch.column(c)) for c in ("tree", "block", "part")), asks])
            edge = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for i, j in zip(edge[:-1], edge[1:]):
                own, piece = tuple(key[:3, i].tolist()), batch.slice(i, j - i)
                if own != now:
                    now, held, data = own, [], None
                ids, string, u, earlier = np.asarray(piece.column("vec_id")), np.asarray(piece.column("string")), lists(piece.column("u"), np.float32), lists(piece.column("earlier"), np.int32).view(np.uint32)
                if not asks[i]:
                    held.append((string, ids, u, earlier))
                    continue
                if data is None and held:
                    order = np.argsort(np.concatenate([h[0] for h in held]), kind="stable")
                    data = [np.concatenate([h[c] for h in held])[order] for c in range(4)]
                if data is not None:
                    yield from found(data, ids, string, u, earlier, np.asarray(piece.column("ends")))

    def found(data, ids, string, u, earlier, ends) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(len(ids)):
            width = 1 << (BITS - int(ends[i]))
            low = int(string[i]) // width * width
            a, b = np.searchsorted(data[0], [low, low + width])
            at = np.arange(a, b)
            if earlier.shape[1]:
                before = (data[3][a:b] ^ earlier[i]) >> np.uint32(BITS - int(ends[i])) == 0 if ends[i] else np.ones((b - a, 1), bool)
                at = at[~before.any(1)]
            if not len(at):
                continue
            score = data[2][at] @ u[i]
            near = np.flatnonzero(score >= (np.partition(score, -k)[-k] if len(score) > k else -2) - slack(u.shape[1]))
            out.append((np.full(len(near), ids[i]), data[1][at[near]], score[near].astype(float), np.zeros(len(near), np.int64)))
            out.append((ids[i : i + 1], np.full(1, -1), np.zeros(1), np.full(1, len(at))))
        if out:
            query, vec, approx, n = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(vec, mask=n > 0), pa.array(approx), pa.array(n)], ["query_id", "vec_id", "approx", "n"])

    return lean(run)


def in_trees(rows: DataFrame, columns: list[str], earlier: bool = False) -> DataFrame:
    """A row for each tree, with the tree's string and, if wanted, those of the trees before it. Vectors of another dimension have other trees."""
    before = F.transform(F.slice("strings", F.lit(1), F.col("local")), lambda x: (x - 2**31).cast("int"))
    more = [before.alias("earlier")] if earlier else []
    t = rows.select(*columns, "strings", F.size("u").alias("d"), F.posexplode("strings").alias("local", "string"))
    return t.select(*columns, "local", "string", *more, (F.col("local") + TREES * F.col("d")).alias("tree"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score, matches): each query's k nearest found by cosine, nearest first, ties to the smaller id, and how many different rows it was held against.

    TREES trees each sort the vectors by a long hash string. A query descends each tree to its longest prefix
    match; then all trees ascend together, a shorter common prefix at a time, until FIRST matches are reached in all. The k-th nearest of
    these tells how far the ascent must go on: rows at an angle t share b bits in a tree with probability
    (1 - t / pi) ** b, and it ends at the longest prefix at which a row as near as the k-th would be missed in all trees
    with no more than the probability MISS. This one rule holds at every size: where near rows are near, few are
    looked at; where all are about as far, as of random directions, about half of the table must be. A row that
    shares the prefix in several trees is scored in the first of them only, so no query is held against more than
    every row once.

    A tree's strings are dealt out in blocks by their leading bits, as many bits as make blocks of BLOCK rows, and
    blocks that are larger for all that in parts. The first pass moves strings alone: in each block binary
    search gives the matches of every prefix length, sums of blocks those of shorter ones, and sums over all trees
    say where the first ascent ends. Two more passes move unit vectors once a tree, and each query to the blocks of
    its range in each tree. Each leaves about k rows a query, which are scored by the original vectors.

    Vectors that are null, empty or zero, or hold null or non-finite components, take no part; nor do rows
    without an id. Vectors of different dimensions are never near. Of equal vectors only the k + 1 smallest ids
    can be results, and only these are indexed; queries of equal vectors are searched for once. Rows of one id count as one,
    by the smaller hash. Fewer candidates than k: all of them. Empty table: no rows. Other columns are ignored.
    """
    v = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), is_query.alias("q"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where((F.size("v") > 0) & F.coalesce(fine, F.lit(False)))
    v = v.groupBy("vec_id").agg(F.min(F.struct(F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), F.col("v")).alias("h2"), "v", "q")).alias("r")).select("vec_id", "r.*")
    v = kept(v.select("vec_id", "v", "h", "h2", "q"))
    copies = Window.partitionBy("h", "h2").orderBy("vec_id")
    only = v.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("vec_id", "v")
    first = v.where("q").groupBy("h", "h2").agg(F.min(F.struct("vec_id", "v")).alias("r"))
    first = kept(first.select("h", "h2", F.col("r.vec_id").alias("query_id"), F.col("r.v").alias("v")))
    schema = "vec_id long, u array<float>, strings array<long>"
    data = kept(only.mapInArrow(hashed, schema))
    queries = kept(first.select(F.col("query_id").alias("vec_id"), "v").mapInArrow(hashed, schema))
    most = k + 1  # a query's own row, or a copy of it, is among the nearest
    n = data.count()
    bits = max(0, round(np.log2(max(1, n / BLOCK))))
    # so many matches in all trees are k + 1 in one at least
    wanted = max(TREES * most, FIRST)
    block = F.shiftright("string", BITS - bits)
    rows, asked = (in_trees(t, ["vec_id"]).withColumn("block", block) for t in (data, queries))
    sizes = kept(rows.groupBy("tree", "block").agg(F.count("*").alias("n")))
    parts = sizes.select("tree", "block", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    key = ["tree", "block", "part"]
    # first pass: strings alone
    names = [*key, "query", "vec_id", "string"]
    mine = rows.join(parts, ["tree", "block"]).withColumn("part", part).withColumn("query", F.lit(False)).select(names)
    theirs = asked.join(parts, ["tree", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("query", F.lit(True)).select(names)
    both = mine.unionByName(theirs).withColumn("bits", F.lit(bits))
    counts = both.repartition(*key).sortWithinPartitions(*key).mapInArrow(prefix_counts, "query_id long, level int, n long")
    for level in range(bits):
        short = sizes.groupBy("tree", F.shiftright("block", bits - level).alias("short")).agg(F.sum("n").alias("n"))
        of = asked.select(F.col("vec_id").alias("query_id"), "tree", F.shiftright("block", bits - level).alias("short"))
        counts = counts.unionByName(of.join(short, ["tree", "short"]).select("query_id", F.lit(level).alias("level"), "n"))
    sums = counts.groupBy("query_id", "level").agg(F.sum("n").alias("n"))
    # the longest prefix with enough matches; with fewer in all, the root
    ends = kept(sums.groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("n") >= wanted, F.col("level"))), F.lit(0)).alias("ends")))

    def scored(levels: DataFrame) -> DataFrame:
        """Matches (query_id, vec_id, approx, n) of queries at the levels (query_id, ends): vectors once a tree, and each query where its range is."""
        names = [*key, "asks", "vec_id", "u", "string", "earlier", "ends"]
        mine = in_trees(data, ["vec_id", "u"], True).withColumn("block", block).join(parts, ["tree", "block"]).withColumn("part", part).withColumns({"asks": F.lit(0), "ends": F.lit(0)}).select(names)
        theirs = in_trees(queries.join(levels, F.col("vec_id") == F.col("query_id")), ["vec_id", "u", "ends"], True).withColumn("block", block)
        theirs = theirs.where("ends > 0 or local = 0")  # all rows share no bits in the first tree already
        first = F.expr(f"shiftleft(shiftright(block, greatest({bits} - ends, 0)), greatest({bits} - ends, 0))")
        theirs = theirs.withColumn("block", F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, greatest({bits} - ends, 0))") - 1)))
        theirs = theirs.join(parts, ["tree", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("asks", F.lit(1)).select(names)
        both = mine.unionByName(theirs).repartition(*key).sortWithinPartitions(*key, "asks")
        return kept(both.mapInArrow(block_matches(most), "query_id long, vec_id long, approx double, n long"))

    near = scored(ends)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("approx").desc(), "vec_id"))
    kth = near.where("vec_id is not null").withColumn("_p", place).where(F.col("_p") <= most).groupBy("query_id").agg(F.min("approx").alias("kth"), F.count("*").alias("found"))
    loose = queries.select(F.col("vec_id").alias("query_id"), (F.greatest(F.lit(16), F.size("u")) * 1e-6).alias("loose"))
    ahead = 1 - F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("kth") - F.col("loose")))) / np.pi
    level = F.when(ahead <= 0, 0).when(ahead >= 1, BITS).otherwise(F.least(F.lit(BITS), F.floor(F.lit(float(np.log(1 - MISS ** (1 / TREES)))) / F.log(ahead))))
    after = ends.join(loose, "query_id").join(kth, "query_id", "left")
    after = after.select("query_id", F.col("ends").alias("_was"), F.least("ends", F.when(F.col("found") >= most, level).otherwise(0)).cast("int").alias("ends"))
    after = kept(after)
    more = after.where("ends < _was").select("query_id", "ends")
    done = near.join(more.select("query_id"), "query_id", "left_anti")
    near = kept(done.unionByName(scored(more)))
    matches = near.groupBy("query_id").agg(F.sum("n").alias("matches"))
    least = F.nth_value("approx", most).over(Window.partitionBy("query_id").orderBy(F.col("approx").desc(), "vec_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    short = near.where("vec_id is not null").withColumn("_least", least).join(loose, "query_id").where(F.col("_least").isNull() | (F.col("approx") >= F.col("_least") - F.col("loose")))
    pairs = short.select("query_id", "vec_id").join(first.select("query_id", F.col("v").alias("q")), "query_id").join(only, "vec_id").select("query_id", "vec_id", "q", "v")
    exact = pairs.mapInArrow(rescored, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    found = kept(exact.withColumn("_r", best).where(F.col("_r") <= most).join(matches, "query_id").select(F.col("query_id").alias("_q"), "vec_id", "score", "matches"))
    # every query of a vector has its results, but for itself
    of = v.where("q").select(F.col("vec_id").alias("query_id"), "h", "h2").join(first.select("h", "h2", F.col("query_id").alias("_q")), ["h", "h2"])
    out = of.join(found, "_q").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return out.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "matches")


def op9_hash_forest(embeddings: DataFrame) -> DataFrame:
    """The five nearest of every row whose vec_id is divisible by 50, and how many rows were scored for it."""
    return nearest(embeddings, F.col("vec_id") % 50 == 0)
