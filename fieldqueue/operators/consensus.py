"""Answers of many people about the same records: consensus by expectation-maximisation, and tests."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldqueue.operators.ordering import ranked
from fieldqueue.sources.shared import kept

#: Answers of a record that stand in one row at most; logins whose accuracies a task holds at most (8 bytes each).
PACK, LOGINS = 4096, 2**22


class Prepared(NamedTuple):
    """Answers by record: `packed` (record, labels, at, code, k), a row a record, and `long` (record, label, at, k), a row an answer, for records of many; logins (at, n); how many wrong labels there are."""

    packed: DataFrame | None
    long: DataFrame | None
    logins: DataFrame
    wrong: float


def prepared(answers: DataFrame) -> Prepared:
    a = kept(answers.where("record is not null").groupBy("login", "record", "label").agg(F.count("*").alias("k")))
    wrong = float(max(1, answers.select("label").distinct().count() - 1))
    logins = kept(ranked(a.where("login is not null").groupBy("login").agg(F.sum("k").alias("n")), [], [F.col("login").asc()], "at"))
    a = a.join(logins.select("login", F.col("at").cast("int").alias("at")), "login", "left").select("record", "label", "at", "k")
    if logins.count() > LOGINS:
        return Prepared(None, kept(a), logins, wrong)
    a = kept(a)
    many = kept(a.groupBy("record").agg(F.count("*").alias("_n")).where(F.col("_n") > PACK).select("record"))
    long = None if many.isEmpty() else kept(a.join(many, "record", "left_semi"))
    few = a if long is None else a.join(many, "record", "left_anti")
    few = few.groupBy("record").agg(F.collect_list(F.struct("label", "at", "k")).alias("r")).withColumn("labels", F.array_distinct(F.transform("r", lambda x: x["label"])))
    few = few.where(F.exists("r", lambda x: x["at"].isNotNull()))  # nobody known answered
    of = lambda f: F.transform("r", f)
    code = of(lambda x: (F.array_position("labels", x["label"]) - 1).cast("int"))
    return Prepared(kept(few.select("record", "labels", of(lambda x: x["at"]).alias("at"), code.alias("code"), of(lambda x: x["k"]).alias("k"))), long, logins, wrong)


def posteriors(batch: pa.RecordBatch, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """The posterior of each label of each row, and of each answer that counts its login, how often it was given and its label's place; rows (size, at, code, k)."""
    size = batch.column("size").to_numpy().astype(np.int64)
    start = np.cumsum(size) - size
    flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float)
    at, code, k = flat("at"), flat("code"), flat("k")
    own = np.repeat(start, batch.column("at").value_lengths().to_numpy())
    known = ~(np.isnan(at) | np.isnan(code))
    at, slot, k = at[known].astype(np.int64), own[known] + code[known].astype(np.int64), k[known]
    like = np.bincount(slot, k * weight[at], size.sum())
    e = np.exp(like - np.repeat(np.maximum.reduceat(like, start), size))
    return e / np.repeat(np.add.reduceat(e, start), size), size, start, at, k, slot


def right_of(weight: np.ndarray) -> Callable:
    """(at, r): the expected right answers of each login in rows (size, at, code, k, truth: the place of the known label, -1 for one that nobody gave, null for none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = np.zeros(len(weight))
        for batch in batches:
            if not batch.num_rows:
                continue
            p, size, start, at, k, slot = posteriors(batch, weight)
            truth = batch.column("truth").to_numpy(zero_copy_only=False).astype(float)
            p[np.repeat(~np.isnan(truth), size)] = 0.0
            held = truth >= 0
            p[start[held] + truth[held].astype(np.int64)] = 1.0
            right += np.bincount(at, k * p[slot], len(weight))
        some = np.flatnonzero(right)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(right[some])], ["at", "r"])

    return run


def settled(weight: np.ndarray) -> Callable:
    """(record, labels, p): the posterior of each label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p, size, *_ = posteriors(batch, weight)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(p))
                yield pa.RecordBatch.from_arrays([batch.column("record"), batch.column("labels"), lists], ["record", "labels", "p"])

    return run


def weight_of(acc: Column, wrong: float) -> Column:
    """What an answer adds to its label's log likelihood beyond what it adds to every label's."""
    return F.log(acc) - F.log((1 - acc) / wrong)


def long_posteriors(rows: DataFrame, skill: DataFrame, wrong: float) -> DataFrame:
    """(record, label, p) of rows (record, label, at, k), for records of any number of answers."""
    j = rows.join(skill, "at", "left").groupBy("record", "label").agg(F.sum(F.when(F.col("label").isNotNull(), F.col("k") * weight_of(F.col("acc"), wrong))).alias("l"), F.max("at").alias("_known"))
    j = j.withColumn("l", F.coalesce("l", F.lit(0.0)))
    top = j.groupBy("record").agg(F.max("l").alias("m"), F.max("_known").alias("_any")).where("_any is not null")
    e = j.join(top, "record").withColumn("e", F.exp(F.col("l") - F.col("m")))
    return e.join(e.groupBy("record").agg(F.sum("e").alias("z")), "record").select("record", "label", (F.col("e") / F.col("z")).alias("p"))


def consensus(answers: DataFrame, rounds: int = 10, planted: DataFrame | None = None, tolerance: float = 0.0) -> DataFrame:
    """(record, label, posterior, accuracy_sum): the likeliest label of every record, from rows (login, record, label).

    One accuracy a login, with one imagined right and one wrong answer; wrong answers spread evenly over the
    labels seen. Each round weighs a record's labels by its answers' logins and counts each login's expected
    right answers. A record's answers stand in one row, so that a round only reads them and shuffles a sum a task and login;
    records of more than PACK answers, and all if there are more than LOGINS logins, go by joins and sums by key instead. Rounds
    are cut apart by written tables. The label of a planted record (rows
    record, label) is held as known while logins are weighed. Rounds end early once no accuracy moves by more than the
    tolerance, if there is one.
    """
    return fitted(prepared(answers), rounds, planted, tolerance)


def fitted(ready: Prepared, rounds: int = 10, planted: DataFrame | None = None, tolerance: float = 0.0) -> DataFrame:
    """consensus() of prepared answers."""
    packed, long, logins, wrong = ready
    known = None if planted is None else planted.select("record", F.col("label").alias("_truth"))
    skill = logins.select("at", F.lit(0.8).alias("acc"))
    work = None
    if packed is not None:
        work, truth = packed, F.lit(None).cast("int")
        if known is not None:
            truth = F.when(F.col("_truth").isNotNull(), F.coalesce(F.array_position("labels", F.col("_truth")), F.lit(0)) - 1).cast("int")
            work = work.join(known, "record", "left")
        work = kept(work.select(F.size("labels").alias("size"), "at", "code", "k", truth.alias("truth")))
    weights = lambda: np.asarray(skill.orderBy("at").select(weight_of(F.col("acc"), wrong).alias("w")).toArrow().column("w"))  # noqa: E731, at most LOGINS
    for _ in range(rounds):
        parts = []
        if work is not None:
            parts.append(work.mapInArrow(right_of(weights()), "at int, r double"))
        if long is not None:
            post = long_posteriors(long, skill, wrong)
            if known is not None:
                post = post.join(known, "record", "left").withColumn("p", F.when(F.col("_truth").isNull(), F.col("p")).otherwise(F.coalesce(F.col("_truth") == F.col("label"), F.lit(False)).cast("double"))).drop("_truth")
            parts.append(long.join(post, ["record", "label"]).where("at is not null").groupBy("at").agg(F.sum(F.col("k") * F.col("p")).alias("r")))
        right = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        before = skill
        skill = kept(logins.join(right.groupBy("at").agg(F.sum("r").alias("r")), "at", "left").select("at", ((F.coalesce("r", F.lit(0.0)) + 1) / (F.col("n") + 2)).alias("acc")))
        if tolerance and (skill.join(before.withColumnRenamed("acc", "_was"), "at").agg(F.max(F.abs(F.col("acc") - F.col("_was")))).first()[0] or 0.0) <= tolerance:
            break
    out = None
    if packed is not None:
        kinds = {f.name: f.dataType.simpleString() for f in packed.schema}
        p = packed.withColumn("size", F.size("labels")).mapInArrow(settled(weights()), f"record {kinds['record']}, labels {kinds['labels']}, p array<double>")
        out = p.select("record", F.array_max(F.zip_with("p", "labels", lambda x, g: F.struct(F.round(x, 9).alias("p"), g.alias("guess")))).alias("b"))
    if long is not None:
        post = long_posteriors(long, skill, wrong)
        best = post.groupBy("record").agg(F.max(F.struct(F.round("p", 9).alias("p"), F.col("label").alias("guess"))).alias("b"))
        out = best if out is None else out.unionByName(best)
    return out.select("record", F.col("b.guess").alias("label"), F.col("b.p").alias("posterior"))


def held_out(answers: DataFrame, planted: DataFrame, threshold: float, folds: int = 2) -> DataFrame:
    """(record, label, truth, wrong): settled consensus of planted records, fitted with their own truth withheld, fold by fold of a hash of the record."""
    fold = F.pmod(F.crc32(F.col("record").cast("string")), F.lit(folds))
    ready, out = prepared(answers), None
    for k in range(folds):
        found = fitted(ready, planted=planted.where(fold != k)).where(F.col("posterior") >= threshold)
        mine = found.join(planted.where(fold == k).withColumnRenamed("label", "truth"), "record")
        mine = mine.select("record", "label", "truth", (F.col("label") != F.col("truth")).cast("int").alias("wrong"))
        out = mine if out is None else out.unionByName(mine)
    return out
