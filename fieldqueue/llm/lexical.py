"""Ranked lexical search by pipelined term partitioning: bundles of sparse accumulators pass through the owners of the terms."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldqueue.llm.bytewords import raw_texts, runs
from fieldqueue.llm.lean import lean
from fieldqueue.llm.shared import kept

#: Documents of a block, as a power of two; pairs of item and term that are searched for at a time, about.
BLOCK, PAIRS = 12, 1 << 19
#: Shares of all postings after which a stage ends, rarest terms first.
STAGES = (0.02, 0.08, 0.25, 1.0)
LONGS, INTS = pa.list_(pa.int64()), pa.list_(pa.int32())


@dataclass
class Items:
    """What the owners need to know of some items, at most about PAIRS numbers: of each stage, each item's terms and their weights times repeats; upper bounds of what a stage and those after it can add."""

    terms: list[list[tuple[np.ndarray, np.ndarray]]]
    rest: np.ndarray


@lean
def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, term, q): how often each term occurs in an item, from rows (item, text)."""
    for batch in batches:
        for item, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
            found: Counter = Counter()
            for words in runs(raw):
                found.update(words)
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["item", "term", "q"])


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tf) of rows (doc_id, text): the number of all terms, and those of `terms`, by their place, with their frequency."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(shared.value)}
        for batch in batches:
            n, own, tf, ends = [], [], [], [0]
            for raw in raw_texts(batch.column(1)):
                total, found = 0, Counter()
                for words in runs(raw):
                    total += len(words)
                    part = Counter(words)
                    for w in part.keys() & place.keys():
                        found[place[w]] += part[w]
                n.append(total)
                at = sorted(found)
                own += at
                tf += [found[i] for i in at]
                ends.append(len(own))
            cut = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(cut, pa.array(own, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(tf, pa.int64()))], ["doc_id", "n", "terms", "tf"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


INDEX = "stage int, block long, terms array<int>, counts array<int>, most array<int>, at array<int>, gain array<int>, ids array<long>"


def inverted(documents: DataFrame, stage: np.ndarray, n: int, length: int) -> DataFrame:
    """INDEX of rows (doc_id, _row, n, terms, tf): for each stage and block of documents its terms, how many documents of the block hold each, the greatest gain, and document by document the place in the block and the gain.

    A gain is (10**9 tf) div (1000 tf + 8 m), without the term's weight. The last stage's rows also hold the ids of the block.
    """
    shared = documents.sparkSession.sparkContext.broadcast(stage)
    last = len(STAGES) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stage, now, held = shared.value, None, []

        def out() -> Iterator[pa.RecordBatch]:
            at, term, gain = (np.concatenate([h[i] for h in held]) for i in range(3))
            ids = pa.concat_arrays([h[3] for h in held])
            places = np.concatenate([h[4] for h in held])
            by_place = [None] * (1 << BLOCK)
            for i, x in zip(places.tolist(), ids.to_pylist()):
                by_place[i] = x
            order = np.lexsort((at, term))
            at, term, gain = at[order], term[order], gain[order]
            for s in range(last + 1):
                own = stage[term] == s
                terms, first, counts = np.unique(term[own], return_index=True, return_counts=True)
                if len(terms) or s == last:
                    most = np.maximum.reduceat(gain[own], first) if len(terms) else np.zeros(0)
                    lists = [pa.array([x.astype(np.int32)], INTS) for x in (terms, counts, most, at[own], gain[own])]
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([now], pa.int64()), *lists, pa.array([by_place if s == last else None], LONGS)], NAMES)

        for batch in batches:
            row, size = np.asarray(batch.column("_row")), np.asarray(batch.column("n"))
            terms, tf = batch.column("terms"), np.asarray(batch.column("tf").flatten())
            counts = np.asarray(terms.value_lengths())
            term, m = np.asarray(terms.flatten()), np.array([25 + 75 * x * n // max(length, 1) for x in size.tolist()], np.int64)
            f = np.minimum(tf, 10**9)  # so many occurrences gain as much as any more
            gain = 10**9 * f // (1000 * f + 8 * np.repeat(m, counts))
            starts = np.concatenate(([0], np.cumsum(counts)))
            block = row >> BLOCK
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(row)] if len(row) else [0]
            for i, j in zip(edges[:-1], edges[1:]):
                if block[i] != now:
                    if held:
                        yield from out()
                    now, held = int(block[i]), []
                a, b = starts[i], starts[j]
                place = row[i:j] & ((1 << BLOCK) - 1)
                held.append((np.repeat(place, counts[i:j]), term[a:b], gain[a:b], batch.column("doc_id").slice(i, j - i), place))
        if held:
            yield from out()

    return documents.mapInArrow(run, INDEX)


NAMES = [c.split()[0] for c in INDEX.split(", ")]


def lists_of(table: pa.Table) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """The (places, gains) of each term in a block's rows."""
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for i in range(table.num_rows):
        terms, counts, at, gain = (np.asarray(table.column(c)[i].values) for c in ("terms", "counts", "at", "gain"))
        ends = np.cumsum(counts)
        for t, a, b in zip(terms.tolist(), (ends - counts).tolist(), ends.tolist()):
            found.setdefault(t, []).append((at[a:b], gain[a:b]))
    return found


def owner(shared, s: int, theta: np.ndarray, k: int):
    """One stage's owner: adds its terms' contributions to the accumulators of a block, and drops those that can't come among the k best."""

    def summed(bundles: pa.Table, index: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, places, sums) of the accumulators that stay."""
        items: Items = shared.value
        lists = lists_of(index)
        carried = {x: i for i, x in enumerate(bundles.column("item").to_pylist())}
        acc = np.zeros(1 << BLOCK, np.int64)
        for item, (terms, weight) in enumerate(items.terms[s]):
            here, after = items.rest[s, item], items.rest[s + 1, item]
            new = here >= theta[item]  # a document without any earlier term may still get there
            if item not in carried and not new:
                continue
            acc[:] = 0
            if item in carried:
                i = carried[item]
                own = np.asarray(bundles.column("at")[i].values)
                acc[own] = np.asarray(bundles.column("sums")[i].values)
            for t, w in zip(terms.tolist(), weight.tolist()):
                for at, gain in lists.get(t, ()):
                    acc[at] += gain.astype(np.int64) * w
            at = np.flatnonzero(acc) if new else own
            at = at[acc[at] + after >= max(theta[item], 1)]
            if len(at) > k:
                at = at[acc[at] + after >= np.partition(acc[at], -k)[-k]]
            if len(at):
                yield item, at, acc[at]

    def block_of(bundles: pa.Table, index: pa.Table) -> int:
        return (bundles if bundles.num_rows else index).column("block")[0].as_py()

    def carry(bundles: pa.Table, index: pa.Table) -> pa.Table:
        out = list(summed(bundles, index))
        best = [np.sort(v)[::-1][:k] for _, _, v in out]
        cols = [pa.array([block_of(bundles, index)] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1].astype(np.int32) for x in out], INTS), pa.array([x[2] for x in out], LONGS), pa.array(best, LONGS)]
        return pa.Table.from_arrays(cols, ["block", "item", "at", "sums", "best"])

    def finish(bundles: pa.Table, index: pa.Table) -> pa.Table:
        ids: list = [None] * (1 << BLOCK)
        for x in index.column("ids").to_pylist():
            ids = [b if a is None else a for a, b in zip(ids, x)]
        none = np.array([x is None for x in ids])
        number = np.array([x or 0 for x in ids], np.int64)
        out = []
        for item, at, v in summed(bundles, index):
            order = np.lexsort((number[at], none[at], -v))[:k]
            out += [(item, ids[i], x) for i, x in zip(at[order].tolist(), v[order].tolist())]
        cols = list(zip(*out)) or [[]] * 3
        return pa.Table.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["item", "doc_id", "score"])

    return finish if s == len(STAGES) - 1 else carry


BUNDLES = "block long, item int, at array<int>, sums array<long>, best array<long>"


def searched(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(item, rank, doc_id, score) for the items whose pairs (item, term, q), about PAIRS, are searched for together."""
    spark = docs.sparkSession
    t = pairs.toArrow()
    terms = sorted(set(t.column("term").to_pylist()))
    place = {x: i for i, x in enumerate(terms)}
    numbers = sorted(set(t.column("item").to_pylist()))
    own = {x: i for i, x in enumerate(numbers)}
    documents = kept(postings(docs, terms).withColumn("_row", F.monotonically_increasing_id()))
    whole = documents.where("n > 0").agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    n, df = whole["n"], np.zeros(len(terms), np.int64)
    for r in documents.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a term searched for
        df[r["t"]] = r["count"]
    # rarest terms first, so that few accumulators are made before most of them can be ruled out
    order = np.argsort(df, kind="stable")
    share = np.cumsum(df[order]) / max(1, df.sum())
    stage = np.zeros(len(terms), np.int8)
    stage[order] = np.searchsorted(np.array(STAGES[:-1]), share)
    index = kept(inverted(documents, stage, n, whole["length"]))
    most = np.zeros(len(terms), np.int64)
    for r in index.select(F.explode(F.arrays_zip("terms", "most")).alias("x")).groupBy("x.terms").agg(F.max("x.most").alias("most")).collect():
        most[r["terms"]] = r["most"]
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()], np.int64)
    item, term = np.array([own[x] for x in t.column("item").to_pylist()], int), np.array([place[x] for x in t.column("term").to_pylist()], int)
    value = weight[term] * np.asarray(t.column("q"))
    rest = np.zeros((len(STAGES) + 1, len(numbers)), np.int64)
    held = []
    for s in reversed(range(len(STAGES))):
        mine = np.flatnonzero((stage[term] == s) & (value > 0))
        mine = mine[np.argsort(item[mine], kind="stable")]
        rest[s] = rest[s + 1]
        np.add.at(rest[s], item[mine], value[mine] * most[term[mine]])
        cut = np.searchsorted(item[mine], np.arange(len(numbers) + 1))
        held.insert(0, [(term[mine[a:b]], value[mine[a:b]]) for a, b in zip(cut[:-1], cut[1:])])
    shared = spark.sparkContext.broadcast(Items(held, rest))
    theta = np.zeros(len(numbers), np.int64)
    bundles = spark.createDataFrame([], BUNDLES)
    for s in range(len(STAGES)):
        stop = s == len(STAGES) - 1
        both = bundles.groupBy("block").cogroup(index.where(F.col("stage") == s).groupBy("block"))
        bundles = both.applyInArrow(owner(shared, s, theta, k), "item int, doc_id long, score long" if stop else BUNDLES)
        if not stop:
            bundles = kept(bundles)
            best = bundles.select("item", F.explode("best").alias("v"))
            nth = F.row_number().over(Window.partitionBy("item").orderBy(F.col("v").desc()))
            for r in best.withColumn("r", nth).where(F.col("r") <= k).groupBy("item").agg(F.max("r").alias("r"), F.min("v").alias("v")).where(F.col("r") == k).collect():
                theta[r["item"]] = r["v"]
            theta = theta.copy()
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    found = bundles.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    names = F.broadcast(spark.createDataFrame(list(enumerate(numbers)), "item int, _item long"))  # one row an item searched for
    return found.join(names, "item").select(F.col("_item").alias("item"), "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: for each item (item_id, text) the k documents (doc_id, text) of the highest score above 0, equal scores by smaller doc_id, null last.

    A score sums weight times gain over the item's terms, repeats included, in whole numbers (see postings and inverted).
    Terms are split between stages, rarest first, whose owners hold their postings by blocks of 2**BLOCK documents, so
    that no term's list meets in one task. Bundles, an item's sparse accumulators in a block, pass from stage to stage
    by cogroup with the owners' postings. After each stage the k-th best sum so far bounds what an
    item's k-th score will be at least, and accumulators that can't reach it with all that later stages may add are
    dropped, as are documents that first appear when nothing can take them there: no result is lost. Items are
    searched for about PAIRS terms at a time, which bounds all that is collected and broadcast.

    Null texts hold no terms. Every row is a document, or an item, of its own, also if ids repeat or are
    null. Items without terms or hits have no rows. Long texts are read whole, in pieces. Empty tables: no rows. Other
    columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = kept(items.select(F.col("item_id").alias("item_id"), "text").withColumn("item", F.monotonically_increasing_id()))
    pairs = kept(own.select("item", "text").mapInArrow(item_terms, "item long, term binary, q long"))
    groups = max(1, -(-pairs.count() // PAIRS))
    group = F.pmod(F.xxhash64("item"), F.lit(groups))
    out = None
    for g in range(groups):
        found = searched(d, pairs.where(group == g), k)
        out = found if out is None else out.unionByName(found)
    return out.join(own.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_search(docs, benchmark)


ORACLE = r"""
with d as (select doc_id, row_number() over () r, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, row_number() over () i, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from benchmark),
it as (select i, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from b),
iq as (select i, t, count(*) q from it group by 1, 2),
dt as (select r, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from d),
tf as (select r, t, count(*) tf from dt group by 1, 2),
tot as (select count(*) filter (where len(w) > 0) n, coalesce(sum(len(w)), 0)::BIGINT l from d),
w as (select t, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT w from tf, tot group by 1),
m as (select r, doc_id, 25 + (75 * len(w) * n) // l m from d, tot where len(w) > 0),
s as (select i, m.r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT score from iq join tf using (t) join w using (t) join m on m.r = tf.r group by 1, 2, 3),
k as (select i, doc_id, score, row_number() over (partition by i order by score desc, doc_id nulls last, r)::INT "rank" from s where score > 0)
select item_id, "rank", doc_id, score from k join b using (i) where "rank" <= 10"""
