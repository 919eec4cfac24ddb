"""The temperature of a margin's weight by maximum likelihood, with an interval over clusters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldqueue.sources.shared import kept

#: Bounds of a temperature, rounds of Newton steps at most, rows weighed at once, tables of sums that reach the driver.
LOW, HIGH, ROUNDS, ROWS, SLOTS = 1e-4, 1.0, 80, 1024, 16
# fixed values: cumulative probabilities of 0 to 5 events at rate 1
POISSON = np.array([0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815])
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


@dataclass
class Fit:
    """The temperature, its mean negative log-likelihood, the number of rows, and the bounds of the interval if there is one."""

    temp: float | None
    loss: float | None
    n: int
    low: float | None = None
    high: float | None = None


def draws(cluster: np.ndarray, reps: int, seed: int) -> np.ndarray:
    """Poisson weights of 64-bit cluster hashes in the whole (column 0, all 1) and in each repetition, which hash, seed and repetition alone decide."""
    x = cluster.astype(np.int64).view(np.uint64)[:, None] + np.uint64(MIX[0]) * (np.arange(1, reps + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32))[None, :]
    for shift, factor in ((30, MIX[1]), (27, MIX[2])):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = (x ^ (x >> np.uint64(31))) / 2.0**64
    return np.concatenate([np.ones((len(u), 1)), np.searchsorted(POISSON, u, "right")], 1)


def sums(rows: DataFrame, beta: np.ndarray, seed: int) -> np.ndarray:
    """Of each repetition's inverse temperature: weights, losses, first and second derivatives, over rows (cluster hash, margin, y). Each task adds up its rows, SLOTS tasks those sums."""
    shared = rows.sparkSession.sparkContext.broadcast(beta)
    reps = len(beta) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slot = np.zeros((4, reps + 1)), 0
        b = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                cluster, m, y = (c.slice(i, ROWS).to_numpy() for c in batch.columns)
                w, z = draws(cluster, reps, seed), m[:, None] * b
                s = np.exp(-np.logaddexp(0, -z))
                loss = np.logaddexp(0, np.where(y[:, None] > 0, z, -z))
                total += [w.sum(0), (w * loss).sum(0), (w * (m[:, None] * (s - 1 + y[:, None]))).sum(0), (w * (m[:, None] ** 2 * s * (1 - s))).sum(0)]
                slot = int(cluster[0] % SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["slot", "s"])

    def added(table: pa.Table) -> pa.Table:
        total = np.sum(table.column("s").to_pylist(), 0)
        return pa.Table.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    found = rows.mapInArrow(run, "slot int, s array<double>").groupBy("slot").applyInArrow(added, "s array<double>").collect()
    shared.unpersist()
    return np.sum([r["s"] for r in found], 0).reshape(4, -1) if found else np.zeros((4, reps + 1))


def fit(rows: DataFrame, reps: int = 0, seed: int = 0, low: float = LOW, high: float = HIGH) -> Fit:
    """The temperature T under which y has the greatest likelihood where its probability is 1 / (1 + exp(margin / T)), from rows (cluster, margin, y).

    The loss is convex in 1 / T: all repetitions take Newton steps together, one pass over the rows each, within brackets
    that every derivative's sign narrows; a step that leaves its bracket halves it. Where the loss still falls at a bound,
    the bound is the fit. The interval holds the middle 95 % of fits over clusters weighed by Poisson draws; a
    repetition that draws nothing is left out, and a null cluster is a cluster of its own row.

    Rows without margin or y are left out; without any row there is no fit.
    """
    own = F.coalesce(F.xxhash64("cluster"), F.xxhash64(F.monotonically_increasing_id()))
    d = rows.where("margin is not null and not isnan(margin) and y is not null")
    h = F.when(F.col("cluster").isNotNull(), F.xxhash64("cluster")).otherwise(own)
    d = kept(d.select(h.alias("h"), F.col("margin").cast("double").alias("margin"), F.col("y").cast("double").alias("y")))
    n = d.count()
    if not n:
        return Fit(None, None, 0)
    lo, hi = np.full(reps + 1, 1 / high), np.full(reps + 1, 1 / low)
    at_low, at_high = sums(d, lo, seed), sums(d, hi, seed)
    some = at_low[0] > 0
    fixed = np.where(at_low[2] >= 0, lo, np.where(at_high[2] <= 0, hi, np.nan))
    fixed[~some] = 1 / high
    beta = np.where(np.isnan(fixed), np.sqrt(lo * hi), fixed)
    s = at_low
    for _ in range(ROUNDS):
        s = sums(d, beta, seed)
        lo, hi = np.where(s[2] < 0, beta, lo), np.where(s[2] >= 0, beta, hi)
        step = beta - s[2] / np.maximum(s[3], 1e-300)
        inside = (step >= lo) & (step <= hi)
        new = np.where(np.isnan(fixed), np.where(inside, step, np.sqrt(lo * hi)), fixed)
        done = (np.abs(new - beta) <= 1e-10 * beta) | (hi <= lo * (1 + 1e-12))
        beta = new
        if done.all():
            break
    temps = 1 / beta
    found = temps[1:][some[1:]]
    ends = np.percentile(found, [2.5, 97.5]).tolist() if len(found) else [None, None]
    return Fit(float(temps[0]), float(s[1][0] / s[0][0]), n, *ends)


def loss(rows: DataFrame, temp: float) -> float | None:
    """Mean negative log-likelihood of rows (margin, y) at a temperature."""
    d = rows.where("margin is not null and y is not null").select(F.lit(0).cast("long").alias("h"), F.col("margin").cast("double"), F.col("y").cast("double"))
    s = sums(d, np.array([1 / temp]), 0)
    return float(s[1][0] / s[0][0]) if s[0][0] else None


def resolved(why: DataFrame, after: DataFrame, leavers: DataFrame, level: str = "narrow") -> DataFrame:
    """(id, cluster, margin, y): records of a level (id, level, looks_like, runner_up, score2) that later were the suggestion (y 0) or the runner-up (y 1).

    Later is the name of those still there at species rank (after: id, taxon_name, rank, user_id), else of those that left
    with a species' name of two words (leavers: id, taxon_name, user_id). Others are left out. Of repeated ids one row counts.
    """
    here = after.where("rank = 'species'").groupBy("id").agg(F.min(F.struct("taxon_name", "user_id")).alias("l"))
    gone = leavers.where(F.size(F.split("taxon_name", " ")) == 2).groupBy("id").agg(F.min(F.struct("taxon_name", "user_id")).alias("l"))
    later = here.unionByName(gone.join(here.select("id"), "id", "left_anti")).select("id", "l.*")
    d = why.where((F.col("level") == level) & F.col("runner_up").isNotNull() & F.col("score2").isNotNull()).join(later, "id")
    y = (F.col("taxon_name") == F.col("runner_up")).cast("int")
    return d.where((F.col("taxon_name") == F.col("looks_like")) | (y == 1)).select("id", F.col("user_id").alias("cluster"), F.col("score2").alias("margin"), y.alias("y"))
