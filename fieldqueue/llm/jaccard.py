"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldqueue.llm.components import components
from fieldqueue.llm.lean import few_rows, lean
from fieldqueue.llm.shared import kept
from fieldqueue.llm.wordhash import JOIN, mixed, shingle_sets

#: Words in a shingle; least similarity in hundredths.
WORDS, LEAST = 5, 80
#: Shingles gathered in a task before they are counted or sent on; a shingle is frequent if tasks that saw it LOCAL times saw it FREQUENT times in all, and so many of them at most are broadcast (16 bytes each).
GATHER, LOCAL, FREQUENT, BROADCAST = 1 << 20, 4, 64, 1 << 19
#: Shingles of a bucket, about.
BUCKET = 1 << 21
#: Classes in a strip of the product: a cluster is cut into SPLIT strips by size, but none of fewer than FINE or more than STRIP; bits of the filter that keeps documents without partners off the network.
FINE, SPLIT, STRIP, FILTER_BITS = 128, 16, 4096, 1 << 24
#: Classes that a task remembers to have sent.
RECENT = 1 << 17
NO_ID = -(2**63)


def prefix_length(n: int) -> int:
    """Sets of which each is in the other's size bounds and that are similar enough share one of so many first members."""
    return n - -(-LEAST * n // 100) + 1


@lean
def class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, n, h1, h2) for each document, and (gram, times) for shingles seen LOCAL times or more."""
    held: list[np.ndarray] = []
    size = 0

    def counted() -> pa.RecordBatch:
        grams, times = np.unique(np.concatenate(held), return_counts=True)
        often = times >= LOCAL
        none = pa.nulls(int(often.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(grams[often].view(np.int64)), pa.array(times[often].astype(np.int64))], names)

    names = ["doc_id", "key", "n", "h1", "h2", "gram", "times"]
    for batch in batches:
        n, marks = [], []
        for s in shingle_sets(batch.column(2), WORDS):
            n.append(len(s))
            marks.append(xxhash.xxh3_128_digest(s.tobytes()))
            held.append(s)
            size += len(s)
            if size >= GATHER:
                yield counted()
                held, size = [], 0
        h = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
        none = pa.nulls(len(n), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), none, none], names)
    if held:
        yield counted()


def incidence(frequent, buckets: int):
    """Packs (shingle, class) incidences by bucket of the shingle: the light shingles, and the frequent ones where these reach into the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        recent = np.zeros(RECENT, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        nodes: list[tuple[int, int]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            grams = np.concatenate([g for g, _ in held])
            index = np.repeat(np.arange(len(held), dtype=np.uint32), [len(g) for g, _ in held]) | (np.concatenate([h for _, h in held]).astype(np.uint32) << np.uint32(31))
            bucket = ((grams >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            low = grams.view(np.uint8).reshape(-1, 8)[order, :6]
            index = index[order]
            # six bytes of the class's hash and three of the room, which stays below 2 ** 23 for any text of fewer than 40 million words
            table = np.array(nodes, np.int64)
            table = np.concatenate((table[:, :1].copy().view(np.uint8)[:, :6], np.clip(table[:, 1:], -(2**23), 2**23 - 1).copy().view(np.uint8)[:, :3]), axis=1)
            rows = []
            for b in range(buckets):
                i, j = cut[b], cut[b + 1]
                if i < j:
                    own, place = np.unique(index[i:j] & np.uint32(0x7FFFFFFF), return_inverse=True)
                    rows.append((b, low[i:j].tobytes(), (place.astype(np.uint32) | (index[i:j] & np.uint32(1 << 31))).tobytes(), table[own].tobytes()))
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]], ["bucket", "grams", "places", "nodes"])

        for batch in batches:
            for s in shingle_sets(batch.column(0), WORDS):
                n = len(s)
                if not n:
                    continue
                node = int(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)[0])
                if recent[node % RECENT] == node:
                    continue
                recent[node % RECENT] = node
                heavy = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s if len(often) else np.zeros(n, bool)
                light = n - int(heavy.sum())
                if light >= prefix_length(n):
                    s, heavy = s[~heavy], heavy[~heavy]
                held.append((s, heavy))
                nodes.append((node, prefix_length(n) - light))
                size += len(s)
                if size >= GATHER:
                    yield packed()
                    held, nodes, size = [], [], 0
        if held:
            yield packed()

    return lean(run)


@lean
def shared_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, gram, rank, room) of every shingle that more than one class has; rows come sorted by bucket.

    rank orders shingles, light before frequent and rare before common; room is what the class's prefix lacks
    if no light shingle of it were shared.
    """

    def found(bucket: int, parts: list) -> pa.RecordBatch:
        total = sum(len(p[1]) for p in parts)
        gram, node, room, heavy = np.zeros((total, 8), np.uint8), np.empty(total, np.int64), np.empty(total, np.int32), np.empty(total, bool)
        at = 0
        for low, place, table in parts:
            j = at + len(place)
            gram[at:j, :6] = low
            which = place & np.uint32(0x7FFFFFFF)
            wide = np.zeros((len(table), 16), np.uint8)
            wide[:, :6], wide[:, 9:12] = table[:, :6], table[:, 6:]
            node[at:j], room[at:j], heavy[at:j] = wide[:, :8].copy().view(np.int64)[which, 0], wide[:, 8:12].copy().view(np.int32)[which, 0] >> 8, place >> np.uint32(31)
            at = j
        g = gram.reshape(-1).view(np.uint64)
        order = np.argsort(g, kind="stable")
        g = g[order]
        same = np.zeros(total, bool)
        same[1:] = g[1:] == g[:-1]
        many = same.copy()
        many[:-1] |= same[1:]
        order, g = order[many], g[many]
        node, room, heavy = node[order], room[order], heavy[order]
        order = np.lexsort((node, g))
        g, node, room, heavy = g[order], node[order], room[order], heavy[order]
        if len(g):
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (node[1:] != node[:-1])
            g, node, room, heavy = g[new], node[new], room[new], heavy[new]
            first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            times = np.diff(np.append(first, len(g)))
            df = np.repeat(times, times)
            ok = df > 1
            g, node, room, heavy, df = g[ok], node[ok], room[ok], heavy[ok], df[ok]
        else:
            df = np.zeros(0, np.int64)
        rank = df.astype(np.int64) + (heavy.astype(np.int64) << 40)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(mixed(g + np.uint64(bucket) * np.uint64(JOIN % 2**32)).view(np.int64)), pa.array(rank), pa.array(room.astype(np.int32))], ["node", "gram", "rank", "room"])

    now, parts = None, []
    for batch in batches:
        for bucket, grams, places, nodes in zip(*(c.to_pylist() for c in batch.columns)):
            if now is not None and bucket != now:
                yield found(now, parts)
                parts = []
            now = bucket
            parts.append((np.frombuffer(grams, np.uint8).reshape(-1, 6), np.frombuffer(places, np.uint32), np.frombuffer(nodes, np.uint8).reshape(-1, 9)))
    if parts:
        yield found(now, parts)


def block_links(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest, as (node, smallest of its tree), of the exact links among a block's sets.

    Sets are ordered by size. For each, the lists of the documents that hold its shingles are added up
    into overlap counts, and counts of documents outside its size bounds or below the bound are discarded.
    """
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    n = np.array([len(s) for s in sets])
    m = len(ids)
    doc = np.repeat(np.arange(m), n)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[column] > 1
    doc, column = doc[keep], column[keep]
    by = np.argsort(column, kind="stable")
    post, start = doc[by], np.searchsorted(column[by], np.arange(len(times) + 1))
    row = np.searchsorted(doc, np.arange(m + 1))
    root = list(range(m))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(1, m):
        c = column[row[i] : row[i + 1]]
        lo = int(np.searchsorted(n[:i], -(-LEAST * n[i] // 100)))
        if lo == i or not len(c):
            continue
        a, size = start[c], start[c + 1] - start[c]
        at = np.repeat(a - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        count = np.bincount(post[at], minlength=m)[lo:i]
        for j in np.flatnonzero(100 * count >= LEAST * (n[i] + n[lo:i] - count)):
            x, y = top(i), top(lo + int(j))
            if x != y:
                root[x] = y
    least: dict[int, int] = {}
    for i in range(m):
        least[top(i)] = min(least.get(top(i), ids[i]), ids[i])
    return [(ids[i], least[top(i)]) for i in range(m) if least[top(i)] != ids[i]]


@lean
def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every block between classes, by their first hash; rows (cluster, low, high, h1, h2, text) come sorted by block. Of rows that share a key only those of the class named count."""
    now, ids, sets, seen = None, [], [], set()

    def linked() -> pa.RecordBatch:
        found = block_links(ids, sets) if len(ids) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    for batch in batches:
        keys = zip(*(batch.column(i).to_pylist() for i in range(5)))
        for (cluster, low, high, h1, h2), s in zip(keys, shingle_sets(batch.column(5), WORDS)):
            if (cluster, low, high) != now:
                yield linked()
                now, ids, sets, seen = (cluster, low, high), [], [], set()
            if h1 not in seen and tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()) == (h1, h2):
                seen.add(h1)
                ids.append(h1)
                sets.append(s)
    yield linked()


def in_filter(bits):
    """Keeps the rows whose key, the first column, may be in a fixed-size filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value
        for batch in batches:
            h = filter_place(np.asarray(batch.column(0)))
            yield batch.filter(pa.array((words[h >> 6] >> (h & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))

    return lean(run)


def filter_place(ids: np.ndarray) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


@lean
def filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = np.unique(filter_place(np.asarray(batch.column(0))))
        words, first = np.unique(h >> 6, return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (h & 63).astype(np.uint64), first) if len(h) else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits.view(np.int64))], ["word", "bits"])


def strips(need: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cluster, n, first, many): the strips of a cluster's classes of n shingles, so many from `first` on; and (cluster, strip, low, high, block): the blocks that a strip is part of.

    From rows (cluster, n), one a class. Strips follow the size and hold a SPLIT-th of the cluster, but FINE classes at
    least and STRIP at most, about; a size that fills several is dealt to them by hash. A block joins two strips if the
    greatest size of the lower is within the bounds of the least of the higher.
    """
    by = need.groupBy("cluster", "n").agg(F.count("*").alias("k"))
    of = Window.partitionBy("cluster")  # distinct sizes, not classes
    room = F.greatest(F.lit(min(FINE, STRIP)), F.least(F.lit(STRIP), F.ceil(F.sum("k").over(of) / SPLIT)))
    upto = F.sum("k").over(of.orderBy("n"))
    by = by.withColumn("room", room).withColumn("upto", upto)
    first, last = F.floor((F.col("upto") - F.col("k")) / F.col("room")).cast("int"), F.floor((F.col("upto") - 1) / F.col("room")).cast("int")
    by = kept(by.select("cluster", "n", first.alias("first"), (last - first + 1).alias("many")))
    s = by.withColumn("strip", F.explode(F.sequence("first", F.col("first") + F.col("many") - 1))).groupBy("cluster", "strip").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    a, b = s.select("cluster", F.col("strip").alias("low"), F.col("most").alias("_most")), s.select("cluster", F.col("strip").alias("high"), F.col("least").alias("_least"))
    pairs = a.join(b, "cluster").where((F.col("low") <= F.col("high")) & (100 * F.col("_most") >= LEAST * F.col("_least")))
    pairs = pairs.withColumn("block", F.row_number().over(Window.partitionBy("cluster").orderBy("high", "low")))
    part = F.explode(F.array_distinct(F.array("low", "high")))
    return by, pairs.select("cluster", "low", "high", "block", part.alias("strip"))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: which documents links of similarity LEAST / 100 or more connect.

    Documents of one shingle set are one class, which a 128-bit hash of the set names. Exact class frequencies
    order shingles from rare to common; two similar classes share a shingle of their prefixes, so classes that
    share none are never compared. Classes which prefixes connect are a cluster, and each cluster is a sparse
    product of its incidence matrix, in blocks of two strips of classes if it has more than FINE. Strips are runs of the
    cluster's classes by size, and only strips whose sizes lie within the bounds of each other meet, so that a cluster
    that common passages hold together costs each class a few blocks and not one for every strip. In a block overlap
    counts accumulate, pairs outside the size-derived bounds are discarded, and the exact links leave the task
    as a spanning forest, never as all pairs. Components of these links give the result.

    Only the frequent shingles (BROADCAST at most) and a filter of FILTER_BITS bits are broadcast; both decide
    what is cheap, not what is found. Incidences are gathered once a class and task, so that copies and very
    common passages don't meet in one task.

    Texts are fetched for the product by a key, a hash of id and text: of rows that have both in common one is moved, and rows
    without an id, or of one id, meet no other's classes.

    Null and empty texts: n_shingles 0, linked with nothing. Rows of one id are separate nodes that share the
    id. A null id counts as smaller than all others and comes back null. Empty table: no rows. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    few_rows(spark)
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    d = docs.select(id_.alias("doc_id"), F.xxhash64(id_, F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    first = kept(d.mapInArrow(class_rows, "doc_id long, key long, n long, h1 long, h2 long, gram long, times long"))
    marks = first.where("doc_id is not null").select("doc_id", "key", "n", "h1", "h2")
    often = first.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("t")).where(F.col("t") >= FREQUENT).orderBy(F.col("t").desc(), "gram").limit(BROADCAST).select("gram").toArrow()
    frequent = spark.sparkContext.broadcast(np.sort(np.asarray(often.column(0)).astype(np.int64).view(np.uint64)))
    buckets = max(1, -(-(marks.agg(F.sum("n")).first()[0] or 0) // BUCKET))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = d.select("text").mapInArrow(incidence(frequent, buckets), "bucket int, grams binary, places binary, nodes binary")
    # a partition for each bucket
    grams = packed.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(shared_grams, "node long, gram long, rank long, room int")
    lists = grams.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("g"), F.first("room").alias("room"), F.count_if(F.col("rank") < 2**40).cast("int").alias("light"))
    take = F.col("room") + F.col("light")
    pre = kept(lists.where(take > 0).select("node", F.explode(F.slice(F.col("g.gram"), F.lit(1), take)).alias("gram")))
    centre = pre.groupBy("gram").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most").select("gram", "b")
    clusters = components(pre.join(centre, "gram").select(F.col("node").alias("a"), "b"))
    classes = kept(marks.where("n > 0").groupBy("h1", "h2").agg(F.first("n").alias("n"), F.min(F.struct("doc_id", "key")).alias("r")).select("h1", "h2", "n", F.col("r.doc_id").alias("rep"), "r.key"))
    need = kept(clusters.join(classes, F.col("node") == F.col("h1").bitwiseAND(F.lit(2**48 - 1))).select("key", "h1", "h2", "n", F.col("component").alias("cluster")))
    sizes, meetings = strips(need)
    found = need.select("key").mapInArrow(filter_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.uint64)
    words[np.asarray(found.column(0))] = np.asarray(found.column(1)).view(np.uint64)
    wanted = d.select("key", "text").mapInArrow(in_filter(spark.sparkContext.broadcast(words)), "key long, text string").groupBy("key").agg(F.first("text").alias("text"))
    own = F.col("first") + F.pmod(F.xxhash64("h1"), F.col("many")).cast("int")
    placed = need.join(sizes, ["cluster", "n"]).select("key", "h1", "h2", "cluster", own.alias("strip"))
    blocks = placed.join(meetings, ["cluster", "strip"]).join(wanted, "key")
    # a cluster's blocks go to one task after another
    place = F.pmod(F.xxhash64("cluster") + F.col("block"), F.lit(parts)).cast("int")
    blocks = blocks.select("cluster", "low", "high", "h1", "h2", "text", "block")
    links = blocks.repartitionById(parts, place).drop("block").sortWithinPartitions("cluster", "low", "high").mapInArrow(product, "a long, b long")
    joined = components(links).join(classes.select(F.col("h1").alias("node"), "rep"), "node")
    least = joined.groupBy("component").agg(F.min("rep").alias("found"))
    joined = joined.join(least, "component").select(F.col("node").alias("h1"), "found")
    named = classes.join(joined, "h1", "left").select("h1", "h2", F.coalesce("found", "rep").alias("found"))
    out = marks.where("n > 0").join(named, ["h1", "h2"]).select("doc_id", "n", "found").unionByName(marks.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("found")))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), real("found").alias("component_id"))
