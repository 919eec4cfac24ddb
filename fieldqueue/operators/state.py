"""Incremental maintenance of a table of records."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of the rows of a key the last in the order."""
    w = Window.partitionBy(*key).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*[c.asc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(pool: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace those of their key; columns of either are kept, null where a row has none."""
    rest = pool.join(new.select(key), key, "left_anti")
    return rest.unionByName(new, allowMissingColumns=True)


def apply_changes(pool: DataFrame, changed: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return upsert(pool.join(gone.select(key), key, "left_anti"), changed, key)


def drop_closed(pool: DataFrame, checked: DataFrame, open_ids: DataFrame, key: str = "id") -> DataFrame:
    """Without those that were checked and not found open; unchecked rows stay."""
    closed = checked.select(key).join(open_ids.select(key), key, "left_anti")
    return pool.join(closed, key, "left_anti")


def reconcile(mine: DataFrame, theirs: DataFrame, key: str = "id") -> DataFrame:
    """(id, side): ids that only one of two tables has."""
    gone = mine.select(key).join(theirs.select(key), key, "left_anti").withColumn("side", F.lit("gone"))
    return gone.unionByName(theirs.select(key).join(mine.select(key), key, "left_anti").withColumn("side", F.lit("missing")))


def leavers(before: DataFrame, after: DataFrame, at: Column, reason: Column) -> DataFrame:
    return before.join(after.select("id"), "id", "left_anti").withColumn("left", at).withColumn("reason", reason)


def tidy_log(log: DataFrame, pool: DataFrame, now: Column, days: int) -> DataFrame:
    """Newest row of each id, not older than so many days, and not of an id that has come back."""
    newest = last_wins(log, ["id"], [F.col("left"), F.col("reason")])
    return newest.where(F.col("left") >= now - F.expr(f"interval {days} days")).join(pool.select("id"), "id", "left_anti")


def differences(expected: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows of one table that the other hasn't, nulls being equal, as often as they are missing."""
    names = expected.columns
    a = expected.exceptAll(rebuilt.select(*names)).withColumn("side", F.lit("expected"))
    return a.unionByName(rebuilt.select(*names).exceptAll(expected).withColumn("side", F.lit("rebuilt")))


class ReplayError(ValueError):
    """A build that can't be repeated as it was."""


def fingerprint(rows: DataFrame) -> str:
    """Names a table's columns and rows, whatever their order: their number, and the sums of two hashes of each."""
    names = sorted(rows.columns)
    total = [F.coalesce(F.sum(F.xxhash64(F.lit(k), *[F.struct(c) for c in names]).cast("decimal(38,0)")), F.lit(0)) for k in (1, 2)]
    r = rows.agg(F.count("*").alias("n"), *[t.alias(f"s{i}") for i, t in enumerate(total)]).first()
    return f"{','.join(names)}:{r['n']}:{r['s0']}:{r['s1']}"


def recorded(pool: DataFrame, key: bytes, settings: dict) -> dict:
    """What a build must note to be repeated: its settings, and fingerprints of pool and key."""
    return {"settings": dict(settings), "pool": fingerprint(pool), "key": sha256(b"key:" + key).hexdigest()}


def replay(record: dict, log: DataFrame, pool: DataFrame, key: bytes, build: Callable[..., DataFrame]) -> DataFrame:
    """Rows of a stored log and of the build repeated from its record that the other lacks, by side; none if all is well.

    A pool or a key that isn't the record's is an error, before anything is built. `build` gets pool, key and the settings.
    """
    if (now := fingerprint(pool)) != record["pool"]:
        raise ReplayError(f"the pool is {now}, the record's was {record['pool']}")
    if sha256(b"key:" + key).hexdigest() != record["key"]:
        raise ReplayError("the key isn't the record's")
    return differences(log, build(pool, key, **record["settings"]))


def coverage(whole: DataFrame, by: str, slack: int) -> DataFrame:
    """One row: rows by part, rows in all, and whether they agree within the slack."""
    parts = whole.where(F.col(by).isNotNull()).groupBy(by).count().agg(F.sum("count").alias("parts"))
    return parts.crossJoin(whole.agg(F.count("*").alias("whole"))).withColumn("covered", F.abs(F.col("parts") - F.col("whole")) <= slack)


def interval_runs(events: DataFrame, runs: DataFrame) -> DataFrame:
    """events with `run`: the first run at or after the event, and `previous`; null after the last run.

    Runs are few and are turned into intervals, the first from the earliest event on; the events' months and those of the
    intervals meet in an equi-join.
    """
    w = Window.orderBy("run")
    earliest = events.agg(F.min("ts").alias("_low"))
    spans = runs.select("run", F.lag("run").over(w).alias("previous")).crossJoin(F.broadcast(earliest))  # one row
    first = F.coalesce("previous", F.least("_low", "run"))
    spans = spans.withColumn("_m", F.explode(F.sequence(F.trunc(first, "MM"), F.trunc(F.col("run"), "MM"), F.expr("interval 1 month"))))
    on = (F.trunc(events["ts"], "MM") == spans["_m"]) & (events["ts"] <= spans["run"]) & (spans["previous"].isNull() | (events["ts"] > spans["previous"]))
    return events.join(spans, on, "left").drop("_m", "_low")


def append_served(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with the rows of a build, in place of any of the same build_date. A record that the log has under another label is an error."""
    old = log.join(rows.select("build_date").distinct(), "build_date", "left_anti")
    before = old.groupBy("id").agg(F.min("label").alias("_before"))
    clash = F.raise_error(F.concat(F.lit("a record has changed its label since an earlier build: "), F.col("id").cast("string")))
    moved = F.col("_before").isNotNull() & (F.col("_before") != F.col("label"))
    fresh = rows.join(before, "id", "left").withColumn("label", F.when(moved, clash.cast("string")).otherwise(F.col("label"))).drop("_before")
    return old.unionByName(fresh)


def append_part(index: DataFrame, part: DataFrame, name: str) -> DataFrame:
    """An index of rows (part, id, ...) with a new part; an id that it has already is an error."""
    held = index.select("id", F.lit(True).alias("_held")).distinct()
    clash = F.raise_error(F.concat(F.lit("the index has this id already: "), F.col("id").cast("string")))
    fresh = part.join(held, "id", "left").withColumn("part", F.when(F.col("_held"), clash.cast("string")).otherwise(F.lit(name))).drop("_held")
    return index.unionByName(fresh)


def compact(index: DataFrame, keep: DataFrame, name: str = "base") -> DataFrame:
    """All parts as one, with the ids that are kept; of an id in several parts the row of the last part."""
    last = last_wins(index, ["id"], [F.col("part")])
    return last.join(keep.select("id"), "id", "left_semi").withColumn("part", F.lit(name))


def changes(rows: DataFrame, since: Column, grades: list[str]) -> DataFrame:
    """Rows updated since: those of a grade in the pool as `kept`, the others as `gone`, and the newest update on each."""
    fresh = rows.where(F.col("updated_at") > since)
    newest = fresh.agg(F.max("updated_at").alias("newest"))
    side = F.when(F.col("grade").isin(grades), "kept").otherwise("gone")
    return fresh.withColumn("side", side).crossJoin(F.broadcast(newest))  # one row


def range_counts(mine: DataFrame, theirs: DataFrame, width: int) -> DataFrame:
    """(low, mine, theirs): id ranges of which two tables hold different numbers."""
    count = lambda t, n: t.groupBy((F.floor(F.col("id") / width) * width).alias("low")).agg(F.count("*").alias(n))
    both = count(mine, "mine").join(count(theirs, "theirs"), "low", "full").fillna(0, ["mine", "theirs"])
    return both.where("mine <> theirs")
