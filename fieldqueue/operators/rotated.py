"""A vector index of lists, rotated product codes and refined residuals, and its upkeep: search, parts, neighbours of what is new, compaction."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldqueue.operators import kbest
from fieldqueue.operators.index import assign as nearest
from fieldqueue.operators.index import unit
from fieldqueue.operators.vectors import exact_neighbours
from fieldqueue.sources.shared import kept

#: Vectors that training reads at most, about, and the tasks that share them; rounds of training.
SAMPLE, TASKS, ROUNDS = 1 << 16, 16, 8
#: Rows of a list that one task scores at a time, and queries about that it scores them for.
SPLIT, ASKED = 50_000, 8192
#: Rows that are coded or decoded at once.
SLICE = 512
#: Share of an index that a compaction may drop.
MAX_DROP = 0.2
# fixed values: step of the best uniform quantiser of a normal error of deviation 1, by bits
STEPS = {1: 1.596, 2: 0.9957, 3: 0.586, 4: 0.3352}


@dataclass
class Books:
    """Centres of the lists, the rotation of what is left, codebooks of its parts (part, code, dimension), and the step of each dimension's refinement."""

    lists: np.ndarray
    rotation: np.ndarray
    parts: np.ndarray
    steps: np.ndarray
    bits: int


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, SLICE rows at a time, so that what a task holds of them doesn't follow their size."""
    for batch in batches:
        yield from (batch.slice(i, SLICE) for i in range(0, batch.num_rows, SLICE))


def vectors_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


def summed(rows: DataFrame, step: Callable[[np.ndarray, object], np.ndarray], state: object) -> np.ndarray:
    """The sum of step(vectors, state) over all batches of rows (id, v): a task adds up its own, so that TASKS rows of fixed size come back."""
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                s = step(vectors_of(batch.column(1)), shared.value)
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    found = rows.select("id", "v").mapInArrow(run, "s array<double>").collect()
    shared.unpersist()
    return np.sum([r["s"] for r in found], 0)


def cluster_sums(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Counts and sums by cluster, in one row."""
    out = np.zeros((k, x.shape[1] + 1))
    np.add.at(out, own, np.concatenate([np.ones((len(x), 1)), x], 1))
    return out


def moved(centres: np.ndarray, sums: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Means of clusters; an empty one takes the next spare vector."""
    n = sums[:, :1]
    out = np.where(n > 0, sums[:, 1:] / np.maximum(n, 1), centres)
    empty = np.flatnonzero(n[:, 0] == 0)
    out[empty] = spare[np.arange(len(empty)) % len(spare)]
    return out


def list_step(x, centres):
    return cluster_sums(x, nearest(x, centres), len(centres)).ravel()


def coded(y: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The nearest code of each part of rotated residuals."""
    return np.stack([nearest(p, book) for p, book in zip(np.split(y, len(parts), 1), parts)], 1)


def decoded(codes: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return parts[np.arange(len(parts))[None, :], codes].reshape(len(codes), -1)


def book_step(x, state):
    """Counts and sums of every code, then the moments of code by residual that the next rotation follows from."""
    centres, rotation, parts = state
    rest = x - centres[nearest(x, centres)]
    y = rest @ rotation.T
    codes = coded(y, parts)
    sums = [cluster_sums(p, c, parts.shape[1]).ravel() for p, c in zip(np.split(y, len(parts), 1), codes.T)]
    return np.concatenate([*sums, (decoded(codes, parts).T @ rest).ravel()])


def error_step(x, state):
    centres, rotation, parts = state
    y = (x - centres[nearest(x, centres)]) @ rotation.T
    e = y - decoded(coded(y, parts), parts)
    return np.concatenate([[len(x)], (e * e).sum(0)])


def train(rows: DataFrame, lists: int, parts: int, codes: int = 256, bits: int = 3, rotate: bool = True, seed: int = 0) -> Books:
    """Codebooks from a sample of about SAMPLE rows (id, v) by hash of the id; every row is indexed later.

    The sample stays in TASKS tasks. Each round is one pass that adds up counts, sums and second moments there, and only these
    reach the driver: rounds of k-means for the lists, then rounds that move the codes of each part to their means and turn
    the rotation to the nearest orthogonal matrix that maps residuals onto their codes (Procrustes, from the moments' singular
    vectors). Vectors must have one length that `parts` divides; zero vectors, null ones and such with null or
    non-finite components are left out. Fewer rows than codes repeat as codes.
    """
    rows = usable(rows)
    n = rows.count()
    if not n:
        raise ValueError("no vectors to train from")
    draw = F.pmod(F.xxhash64(F.lit(f"train:{seed}"), F.col("id")), F.lit(1 << 30))
    sample = kept(rows.where(draw < min(1.0, SAMPLE / n) * (1 << 30)).select("id", "v").repartition(TASKS, "id"))
    # the rows of least hash start as centres and codes
    most = max(lists, codes)
    first = sample.orderBy(F.xxhash64(F.lit(f"start:{seed}"), "id"), "id").limit(2 * most).toArrow()
    start = vectors_of(first.column("v").combine_chunks())
    d = start.shape[1]
    if d % parts:
        raise ValueError(f"{parts} parts don't divide {d} dimensions")
    rng = np.random.default_rng(seed)
    spare = start[rng.permutation(len(start))]
    centres = start[: min(lists, len(start))].copy()
    for _ in range(ROUNDS):
        centres = moved(centres, summed(sample, list_step, centres).reshape(len(centres), -1), spare)
    rest = start - centres[nearest(start, centres)]
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0] if rotate else np.eye(d)
    split = lambda y: np.stack([np.resize(p, (codes, d // parts)) for p in np.split(y, parts, 1)])
    books = split(rest @ rotation.T)
    for _ in range(ROUNDS):
        s = summed(sample, book_step, (centres, rotation, books))
        size = codes * (d // parts + 1)
        spare_parts = np.split(rest @ rotation.T, parts, 1)
        books = np.stack([moved(books[j], s[j * size : (j + 1) * size].reshape(codes, -1), spare_parts[j]) for j in range(parts)])
        if rotate:
            u, _, v = np.linalg.svd(s[parts * size :].reshape(d, d))
            rotation = u @ v
    e = summed(sample, error_step, (centres, rotation, books))
    return Books(centres, rotation, books, STEPS[bits] * np.sqrt(e[1:] / e[0]), bits)


def usable(rows: DataFrame) -> DataFrame:
    """Rows (id, v) of ids and vectors that can be indexed: not null, not zero, finite."""
    v = F.transform("v", lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where("id is not null").where(F.coalesce(fine, F.lit(False))).select(F.col("id").cast("long").alias("id"), v.alias("v"))


def packed(levels: np.ndarray, bits: int) -> list[bytes]:
    planes = (levels[:, :, None] >> np.arange(bits)) & 1
    return [r.tobytes() for r in np.packbits(planes.reshape(len(levels), -1).astype(bool), axis=1)]


def unpacked(raw: np.ndarray, d: int, bits: int) -> np.ndarray:
    planes = np.unpackbits(raw, axis=1, count=d * bits).reshape(len(raw), d, bits)
    return sum((planes[:, :, i] << i for i in range(1, bits)), planes[:, :, 0])


def middles(levels: np.ndarray, books: Books) -> np.ndarray:
    """What refinement adds to the codes, in rotated dimensions: the middle of each level."""
    return (levels - ((1 << books.bits) - 1) / 2) * books.steps


def refined(refine: list[bytes], books: Books) -> np.ndarray:
    return middles(unpacked(np.frombuffer(b"".join(refine), np.uint8).reshape(len(refine), -1), len(books.steps), books.bits), books)


def encoded(rows: DataFrame, books: Books) -> DataFrame:
    """(id, list, codes, refine) of every usable row (id, v): the nearest centre, the codes of the rotated rest, and BITS bits a dimension of what they miss."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in sliced(batches):
            x = vectors_of(batch.column(1))
            own = nearest(x, b.lists)
            y = (x - b.lists[own]) @ b.rotation.T
            codes = coded(y, b.parts)
            step = np.maximum(b.steps, 1e-30)
            top = (1 << b.bits) - 1
            levels = np.clip(np.rint((y - decoded(codes, b.parts)) / step + top / 2), 0, top).astype(np.int64)
            cols = [pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(packed(levels, b.bits), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", "list", "codes", "refine"])

    return usable(rows).mapInArrow(run, "id long, list int, codes binary, refine binary")


def codes_of(column: list[bytes], parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), parts).astype(int)


def reconstructed(index: DataFrame, books: Books) -> DataFrame:
    """(id, v): unit vectors from the codes and refinements of index rows (id, list, codes, refine, part if there is one); of an id in two parts the later counts."""
    shared = index.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in sliced(batches):
            y = decoded(codes_of(batch.column("codes").to_pylist(), len(b.parts)), b.parts) + refined(batch.column("refine").to_pylist(), b)
            x = unit(b.lists[np.asarray(batch.column("list"))] + y @ b.rotation)
            flat = pa.array(x.ravel())
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([batch.column("id"), v], ["id", "v"])

    return latest(index).select("id", "list", "codes", "refine").mapInArrow(run, "id long, v array<double>")


def latest(index: DataFrame) -> DataFrame:
    """Of each id the row of its last part."""
    if "part" not in index.columns:
        return index
    return index.groupBy("id").agg(F.max_by(F.struct(*[c for c in index.columns if c != "id"]), "part").alias("r")).select("id", "r.*")


def held(queries: pa.Table, data: pa.Table, b: Books, k: int, shortlist: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, nb, cos) of the k best of one list's rows, which come by id, for some queries, in strips of queries; equal rows and equal queries are scored once.

    All in rotated dimensions, where a row's codes and refinement decode to what the query's turned vector is multiplied with. Products are
    found in single precision; what decides the shortlist or the k best within its error is scored again in double.
    """
    ids, base = np.asarray(data.column("id")), b.lists[data.column("list")[0].as_py()]
    raw = [np.frombuffer(b"".join(data.column(c).to_pylist()), np.uint8).reshape(len(ids), -1) for c in ("codes", "refine")]
    first, own = kbest.classes(np.concatenate(raw, 1))
    member, size = kbest.members(own, ids, k + 1)
    codes, levels = raw[0][first], unpacked(raw[1][first], len(b.steps), b.bits)
    by_code = lambda at: decoded(codes[at], b.parts)
    whole = lambda at: by_code(at) + middles(levels[at], b)
    asked, v = np.asarray(queries.column("id")), vectors_of(queries.column("v").combine_chunks())
    # a query that no other row equals isn't on its own shortlist
    at = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
    alone = np.where((ids[at] == asked) & (size[own[at]] == 1), own[at], -1)
    some, mine = kbest.classes(np.concatenate([v, alone[:, None]], 1))
    names, ends = np.argsort(mine, kind="stable"), np.cumsum(np.bincount(mine))
    turned, to_base, alone = v[some] @ b.rotation.T, v[some] @ base, alone[some]
    single = lambda f: np.concatenate([f(np.arange(i, min(len(first), i + SLICE))).astype(np.float32) for i in range(0, len(first), SLICE)])
    rough, x, y = turned.astype(np.float32), single(by_code), single(whole)
    off, off_whole, x = kbest.error(turned, x), kbest.error(turned, y), np.ascontiguousarray(x.T)
    for i, j in kbest.strips(len(some), max(len(first), min(shortlist, len(first)) * turned.shape[1])):
        q, out = turned[i:j], np.flatnonzero(alone[i:j] >= 0)
        s = rough[i:j] @ x
        s[out, alone[i:j][out]] = -np.inf
        row, column = kbest.shortlist(s, shortlist, off, lambda r, c: kbest.dots(q, r, by_code, c))  # noqa: B023
        place = kbest.numbered(row)
        listed, there = (np.zeros((j - i, place.max(initial=0) + 1), t) for t in (np.int64, bool))
        listed[row, place], there[row, place] = column, True
        near = np.where(there, np.matmul(y[listed], rough[i:j, :, None])[:, :, 0], np.float32(-np.inf))
        row, place = kbest.likely(near, k + 1, off_whole)
        column = listed[row, place]
        score = to_base[i:j][row] + kbest.dots(q, row, whole, column)
        who = names[ends[i - 1] if i else 0 : ends[j - 1]]
        yield kbest.named(row, column, score, member, size, asked[who], mine[who] - i, k)


def search(index: DataFrame, queries: DataFrame, books: Books, k: int, probe: int, shortlist: int, pad: bool = True) -> DataFrame:
    """(id, place, nb, cos): the k nearest found of each query (id, v) in its `probe` nearest lists, itself left out, by codes alone; no vector of the index is needed.

    In each list the `shortlist` best by code get their refinement, and the best of these are the result; ties to the
    smaller id. Rows of equal codes and refinement count once on the shortlist. A list of more than SPLIT rows is read in
    parts, to each of which its queries go, ASKED or so at a time. With `pad`, places beyond what was found
    hold nb -1 and cos -infinity. Of an id in two parts the later counts.
    """
    shared = index.sparkSession.sparkContext.broadcast(books)
    rows = kept(latest(index).select("id", "list", "codes", "refine"))
    sizes = F.broadcast(rows.groupBy("list").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("shares")))  # one row a list of the codebook

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = vectors_of(batch.column(1)) if batch.num_rows else np.zeros((0, shared.value.lists.shape[1]))
            near = np.argsort(-(q @ shared.value.lists.T), 1, kind="stable")[:, :probe].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], ["id", "v", "lists"])

    asked = kept(usable(queries).mapInArrow(probed, "id long, v array<double>, lists array<int>"))
    turns = F.broadcast(asked.select(F.explode("lists").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("turns")))  # likewise
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    to = asked.select("id", "v", F.explode("lists").alias("list")).join(sizes, "list").join(turns, "list")
    to = to.withColumn("share", upto("shares")).withColumn("turn", F.pmod(F.xxhash64("id"), F.col("turns")).cast("int"))
    data = rows.join(sizes, "list").join(turns, "list").withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")).withColumn("turn", upto("turns"))

    def scan(queries: pa.Table, data: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and data.num_rows:
            out = list(held(queries.combine_chunks(), data.sort_by("id").combine_chunks(), shared.value, k, shortlist))
        cols = [np.concatenate(x) for x in zip(*out)] or [[]] * 3
        return pa.Table.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["id", "nb", "cos"])

    # groups are small in bytes and long in work: dealt out by their number, not by their size
    by = ["list", "share", "turn"]
    groups = sizes.join(turns, "list").agg(F.coalesce(F.sum(F.col("shares") * F.col("turns")), F.lit(1))).first()[0]
    to, data = to.select(*by, "id", "v").repartition(2 * groups, *by), data.repartition(2 * groups, *by)
    found = to.groupBy(*by).cogroup(data.groupBy(*by)).applyInArrow(scan, "id long, nb long, cos double")
    found = best_of(found, k)
    if not pad:
        return found
    every = asked.select("id").distinct().withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return every.join(found, ["id", "place"], "left").select("id", "place", F.coalesce("nb", F.lit(-1)).alias("nb"), F.coalesce("cos", F.lit(float("-inf"))).alias("cos"))


def best_of(found: DataFrame, k: int) -> DataFrame:
    """(id, place, nb, cos): the k best of candidates (id, nb, cos), each neighbour once, by its greatest cosine; ties to the smaller id."""
    once = found.repartition("id").groupBy("id", "nb").agg(F.max("cos").alias("cos"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.round("cos", 12).desc(), "nb"))
    return once.withColumn("place", rank).where(F.col("place") <= k).select("id", "place", "nb", "cos")


def delta_neighbours(index: DataFrame, new: DataFrame, books: Books, k: int, probe: int, shortlist: int) -> DataFrame:
    """(id, place, nb, cos) of new rows (id, v) before they are appended: exact cosines among the new ones, scores by code against the index, the k best of both.

    Scores by code stand for cosines within the codes' error. Places beyond the candidates hold nb 0 and cos -1; cosines
    are cut to -1 and 1. A new row that the index holds already isn't its own neighbour.
    """
    new = kept(usable(new))
    among = exact_neighbours(new, new, k).select("id", "nb", "cos")
    old = search(index, new, books, k, probe, shortlist, pad=False).select("id", "nb", "cos")
    found = best_of(among.unionByName(old), k).withColumn("cos", F.greatest(F.least("cos", F.lit(1.0)), F.lit(-1.0)))
    every = new.select("id").distinct().withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return every.join(found, ["id", "place"], "left").select("id", "place", F.coalesce("nb", F.lit(0)).alias("nb"), F.coalesce("cos", F.lit(-1.0)).alias("cos"))


@dataclass
class Index:
    """Rows (part, id, list, codes, refine), neighbour lists (part, id, place, nb, cos), and the codebooks of both."""

    rows: DataFrame
    neighbours: DataFrame
    books: Books


def build(rows: DataFrame, books: Books, k: int, probe: int, shortlist: int) -> Index:
    """Part 0 of an index: every usable row (id, v), and its neighbour list."""
    index = kept(encoded(rows, books).withColumn("part", F.lit(0)))
    near = search(index, rows, books, k, probe, shortlist).select(F.lit(0).alias("part"), "id", "place", "nb", "cos")
    return Index(index, kept(near), books)


def apply(index: Index, new: DataFrame, live: DataFrame, k: int, probe: int, shortlist: int) -> Index:
    """The index with one more part: the new rows (id, v) that are live (id) and not indexed yet, with their neighbour lists.

    Repeated ids among the new rows are an error, as are vectors of another length. Ids and lists go through joins, and
    the parts that were there stay as written.
    """
    new = kept(usable(new))
    odd = new.groupBy("id").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).where((F.col("n") > 1) | (F.col("d") != len(index.books.steps))).limit(1).collect()
    if odd:
        raise ValueError(f"id {odd[0]['id']}: {odd[0]['n']} vectors, of {odd[0]['d']} dimensions where the index has {len(index.books.steps)}")
    fresh = kept(new.join(live.select("id").distinct(), "id", "left_semi").join(index.rows.select("id").distinct(), "id", "left_anti"))
    last = index.rows.agg(F.max("part")).first()[0]
    part = 0 if last is None else last + 1
    near = delta_neighbours(index.rows, fresh, index.books, k, probe, shortlist)
    rows = kept(encoded(fresh, index.books).withColumn("part", F.lit(part)))
    return Index(index.rows.unionByName(rows), index.neighbours.unionByName(kept(near.withColumn("part", F.lit(part)))), index.books)


def compacted(index: Index, live: DataFrame, max_drop: float = MAX_DROP) -> Index:
    """The index as one part 0 of the live ids (id), the later part's row and list of each; refused as a whole if more than max_drop of its ids would go.

    Neighbours that are no longer live stay in the lists of others: who reads a list leaves them out.
    """
    now = live.select("id").distinct()
    ids = index.rows.select("id").distinct().join(now.withColumn("_live", F.lit(True)), "id", "left")
    total, gone = ids.agg(F.count("*"), F.count_if(F.col("_live").isNull())).first()
    if gone > max_drop * total:
        raise ValueError(f"compaction would drop {gone} of {total} ids: are the live ones whole?")
    rows = latest(index.rows).join(now, "id", "left_semi").withColumn("part", F.lit(0)).select(index.rows.columns)
    newest = index.neighbours.groupBy("id").agg(F.max("part").alias("part"))
    near = index.neighbours.join(newest, ["id", "part"]).join(now, "id", "left_semi").withColumn("part", F.lit(0)).select(index.neighbours.columns)
    return Index(kept(rows), kept(near), index.books)
