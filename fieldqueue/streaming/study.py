"""Batches of a study served one at a time: lists take turns, each list goes on where a browser left it and wraps around."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import md5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Milliseconds of event time for which a browser's place is remembered, unless told otherwise.
KEEP = 90 * 86_400_000
SERVED = "browser string, grp string, press long, label string, idx int, number int"
STATE = "step int, served int, pointers map<string, int>"

Sizes = dict[str, dict[str, int]]


def draw(seed: int, *parts: str) -> int:
    return int(md5(":".join([str(seed), *parts]).encode()).hexdigest()[:15], 16)


def turn_order(browser: str, sizes: Sizes, seed: int) -> list[str]:
    """The order in which a browser's lists take turns, drawn once by seed and browser."""
    return sorted(sizes, key=lambda label: (draw(seed, browser, label), label))


def offset(browser: str, label: str, grp: str, n: int, seed: int) -> int:
    """The batch at which a browser starts in a list."""
    return draw(seed, browser, label, grp) % n if n else 0


def next_batch(step: int, served: int, pointers: dict[str, int], order: list[str], sizes: Sizes, grp: str) -> tuple[int, int, dict[str, int], str | None, int]:
    """The state after a press, and the list and pointer that it gets; no list if all are through."""
    for k in range(len(order)):
        label = order[(step + k) % len(order)]
        at = pointers.get(label, 0)
        if at < sizes[label].get(grp, 0):
            return step + k + 1, served + 1, {**pointers, label: at + 1}, label, at
    return step + len(order), served, pointers, None, -1


def pressed(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState, sizes: Sizes, seed: int, keep: int) -> Iterator[pd.DataFrame]:
    """One row a press of a browser in a group."""
    if held.hasTimedOut:
        held.remove()
        return
    browser, grp = key
    step, served, pointers = held.get if held.exists else (0, 0, {})
    pointers, order, out, last = dict(pointers), turn_order(browser, sizes, seed), [], held.getCurrentWatermarkMs()
    rows = pd.concat(list(batches)).sort_values(["ts", "press"])
    for at, press in rows[["ts", "press"]].itertuples(index=False):
        last = max(last, int(at.timestamp() * 1000))
        step, served, pointers, label, i = next_batch(step, served, pointers, order, sizes, grp)
        n = sizes[label][grp] if label else 0
        out.append((browser, grp, press, label, (offset(browser, label, grp, n, seed) + i) % n if label else None, served))
    held.update((step, served, pointers))
    held.setTimeoutTimestamp(last + keep)
    frame = pd.DataFrame(out, columns=["browser", "grp", "press", "label", "idx", "number"])
    yield frame.astype({"idx": "Int32"})


def serve(presses: DataFrame, sizes: Sizes, seed: int = 0, late: str = "1 hour", keep: int = KEEP) -> DataFrame:
    """The batch that each press (browser, grp, press, ts) gets: its list and the batch's index there, null once all are through, and how many were served.

    Lists take turns in an order drawn for the browser, those that are through are passed over; in a list a browser starts at its own batch and
    wraps around, so that it gets every batch once. State: a step, a count and a pointer a list, for each
    browser and group, until `keep` milliseconds of event time without a press. `sizes` has the number of batches by list and group.
    """
    step = partial(pressed, sizes=sizes, seed=seed, keep=keep)
    return presses.withWatermark("ts", late).groupBy("browser", "grp").applyInPandasWithState(step, SERVED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
