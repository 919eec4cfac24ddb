"""Batches grown by similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldqueue.operators.ordering import ranked
from fieldqueue.sources.shared import kept


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-30)


def assign(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest centre of each row."""
    return ((centres * centres).sum(1) / 2 - x @ centres.T).argmin(1)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Rows of a cell at most, about; centres a cell is split by at most; cells split at once; splits after which rows are dealt by hash.
CELL, CENTRES, AT_ONCE, DEPTH = 2048, 16, 1000, 6


def cells(d: DataFrame) -> DataFrame:
    """The rows (cell, id, v, ...) with cells of more than CELL rows split by nearest of a few of their rows, again and again; what that can't part, as equal vectors, is dealt by hash."""
    d = kept(d.withColumn("depth", F.lit(0)))
    while True:
        large = d.groupBy("cell", "depth").count().where(F.col("count") > CELL).orderBy("depth", "cell").limit(AT_ONCE).collect()
        if not large:
            return d
        # the cell's rows of least hash are its centres
        parts = {r["cell"]: -(-2 * r["count"] // CELL) for r in large}
        chosen = F.broadcast(d.sparkSession.createDataFrame([(r["cell"], min(1.0, 2.0 * CENTRES / r["count"])) for r in large if r["depth"] < DEPTH], "cell string, share double"))
        draw = F.pmod(F.xxhash64(F.lit("centre"), "depth", "id"), F.lit(1 << 30))
        centres: dict[str, list] = {}
        for r in d.join(chosen, "cell").where(draw < F.col("share") * (1 << 30)).select("cell", "v").collect():
            centres.setdefault(r["cell"], []).append(r["v"])
        near = {c: unit(np.array(v[: max(2, min(CENTRES, parts[c]))])) for c, v in centres.items()}
        shared = d.sparkSession.sparkContext.broadcast((near, parts))

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near, parts = shared.value
            for batch in batches:
                cell = np.array(batch.column("cell").to_pylist(), object)
                draw, depth = (np.asarray(batch.column(c)) for c in ("draw", "depth"))
                part = np.full(len(cell), -1)
                for c in set(cell.tolist()) & set(parts):
                    own = np.flatnonzero(cell == c)
                    part[own] = assign(unit(np.array(batch.column("v").take(pa.array(own)).to_pylist())), near[c]) if c in near else draw[own] % parts[c]
                now = [f"{c}/{p}" if p >= 0 else c for c, p in zip(cell.tolist(), part.tolist())]
                put = {"cell": pa.array(now, pa.string()), "depth": pa.array((depth + (part >= 0)).astype(np.int32))}
                yield pa.RecordBatch.from_arrays([put.get(n, batch.column(n)) for n in names], names)

        names = d.columns
        d = kept(d.withColumn("draw", F.pmod(F.xxhash64(F.lit("part"), "depth", "id"), F.lit(1 << 30))).mapInArrow(split, d.schema))


def similarity_order(rows: DataFrame, by: str, size: int) -> DataFrame:
    """(by, batch, place, id) of every row (by, id, v, score): batches of `size` grown around far-apart seeds, and the place in the batch.

    A group of more than CELL rows is split into cells first, each of which grows its batches in one task, its
    last one perhaps short. Batches of a group are ordered by mean score, those without one last; rows of a batch by
    cosine to its centre. Rows without a usable vector (null, zero or not finite) follow in batches of their own,
    newest id first.
    """
    kind = rows.schema[by].dataType.simpleString()
    score = F.col("score").cast("double")
    d = rows.select(by, F.col("id").cast("long").alias("id"), F.transform("v", lambda x: x.cast("double")).alias("v"), F.when(F.abs(score) < float("inf"), score).alias("score"))
    norm = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    d = kept(d.withColumn("usable", F.coalesce((norm > 0) & (norm < float("inf")), F.lit(False))))

    def grow(table: pa.Table) -> pa.Table:
        t = table.combine_chunks().sort_by("id")
        x, score = unit(np.array(t.column("v").to_pylist(), np.float64)), t.column("score").to_numpy().astype(np.float64)
        n = len(x)
        free, near, batch, place = np.ones(n, bool), np.full(n, -np.inf), np.zeros(n, np.int32), np.zeros(n, np.int32)
        mean = np.full(n, np.nan)
        for number in range(-(-n // size)):
            at = int(np.where(free, near if number else -x @ x.mean(0), np.inf).argmin())
            centre, own = np.zeros(x.shape[1]), []
            near = np.maximum(near, x @ x[at])
            while len(own) < size and free.any():
                if own:
                    at = int(np.where(free, x @ centre, -np.inf).argmax())
                free[at] = False
                own.append(at)
                centre += x[at]
            batch[own], place[np.array(own)[np.argsort(-(x[own] @ centre), kind="stable")]] = number, np.arange(len(own))
            known = score[own][~np.isnan(score[own])]
            mean[own] = known.mean() if len(known) else np.nan
        return pa.Table.from_arrays([t.column(by), t.column("cell"), pa.array(batch), pa.array(place), t.column("id"), pa.array(mean, from_pandas=True)], [by, "cell", "number", "place", "id", "mean"])

    parted = cells(d.where("usable").withColumn("cell", F.to_json(F.struct(by)))).select(by, "cell", "id", "v", "score")
    grown = kept(parted.groupBy("cell").applyInArrow(grow, f"{by} {kind}, cell string, number int, place int, id long, mean double"))
    batches = ranked(grown.where("place = 0").select(by, "cell", "number", "mean"), [by], [F.col("mean").desc_nulls_last(), F.col("cell"), F.col("number")], "batch")
    head = grown.join(batches.select("cell", "number", "batch"), ["cell", "number"]).select(by, "batch", "place", "id")
    count = batches.groupBy(by).count().withColumnRenamed(by, "_by")
    tail = ranked(d.where("not usable").select(by, "id"), [by], [F.col("id").desc_nulls_last()], "_tail").join(count, F.col(by).eqNullSafe(F.col("_by")), "left")
    tail = tail.select(by, (F.coalesce("count", F.lit(0)) + F.floor(F.col("_tail") / size)).alias("batch"), (F.col("_tail") % size).cast("int").alias("place"), "id")
    return head.unionByName(tail).withColumn("batch", F.col("batch").cast("int"))
