"""Structured Streaming forms of the daily upkeep."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldqueue.operators import state


def fresh(events: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def counts(events: DataFrame, at: str, late: str, size: str, *by: str) -> DataFrame:
    """Events by window and key; windows close once the watermark has passed them."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), *by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, at: str, late: str, gap: str, user: str) -> DataFrame:
    """A user's sessions: events without a longer gap between them."""
    out = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def upsert_stream(changes: DataFrame, path: str, checkpoint: str, key: str = "id", at: str = "updated_at") -> StreamingQuery:
    """Keeps a table of the newest row of every key: each micro-batch is folded into the last version, under its own number.

    A batch that is run again writes the same version again.
    """

    def fold(batch: DataFrame, number: int) -> None:
        new = state.last_wins(batch, [key], [F.col(at)])
        if number:
            new = state.last_wins(batch.sparkSession.read.parquet(f"{path}/v{number - 1}").unionByName(new), [key], [F.col(at)])
        new.write.mode("overwrite").parquet(f"{path}/v{number}")

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Milliseconds of event time for which a record without new votes is remembered, unless told otherwise.
KEEP = 365 * 86_400_000
GRADE = "id long, reached timestamp, n long, agree long"


def grade_reached(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState, keep: int = KEEP) -> Iterator[pd.DataFrame]:
    """When a record first has two votes for one answer that are more than two thirds of all; one row a record, unless it had been forgotten."""
    if held.hasTimedOut:
        held.remove()
        return
    done, votes = held.get if held.exists else (False, {})
    votes, last = dict(votes), held.getCurrentWatermarkMs()
    for rows in batches:
        last = max(last, int(rows["ts"].max().timestamp() * 1000))
        for at, answer in rows.sort_values("ts")[["ts", "answer"]].itertuples(index=False):
            if done:
                break
            votes[answer] = votes.get(answer, 0) + 1
            n, most = sum(votes.values()), max(votes.values())
            if most >= 2 and 3 * most > 2 * n:
                done = True
                yield pd.DataFrame({"id": [key[0]], "reached": [at], "n": [n], "agree": [most]})
    held.update((done, votes))
    held.setTimeoutTimestamp(last + keep)


def grades(votes: DataFrame, late: str = "1 day", keep: int = KEEP) -> DataFrame:
    """Rows (id, ts, answer) as they come; a record's row as soon as its grade is reached.

    State: one count an answer, until the watermark is `keep` milliseconds beyond the record's last vote.
    """
    reached = partial(grade_reached, keep=keep)
    return votes.withWatermark("ts", late).groupBy("id").applyInPandasWithState(reached, GRADE, "done boolean, votes map<string, long>", "append", GroupStateTimeout.EventTimeTimeout)
