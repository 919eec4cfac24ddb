"""Row-wise derivations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped_blend(parts: dict[str, float]) -> Column:
    """Weighted sum of columns, from 0 to 1."""
    total = F.lit(0.0)
    for name, weight in parts.items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * weight
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def range_note(label_in: Column, other_in: Column) -> Column:
    """What two yes, no or unknown answers say together: both out, only the label in, only the other in, or nothing."""
    return F.when(label_in.isNull() | other_in.isNull(), None).when(~label_in & ~other_in, "both out").when(label_in & ~other_in, "label").when(~label_in & other_in, "other").otherwise(None)


def right_closed(x: Column, edges: list[float], names: list[str]) -> Column:
    """The bin (edge, next edge] of a number; null outside."""
    out = F.lit(None).cast("string")
    for low, high, name in reversed(list(zip(edges, edges[1:], names))):
        out = F.when((x > low) & (x <= high), name).otherwise(out)
    return out


def plain_name(name: Column) -> Column:
    """Lower case, anything but letters and digits one space."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def calendar_bin(day: Column, days: int) -> Column:
    """The day, week, month or year of a day, as the span is up to 92 days, two years, 25 years or longer."""
    unit = "day" if days <= 92 else "week" if days <= 732 else "month" if days <= 25 * 366 else "year"
    return F.date_trunc(unit, day).cast("date")


def tier(statuses: Column) -> Column:
    """The most serious conservation tier that a list of statuses holds: 1, 2, 3 or null."""
    has = lambda *s: F.exists(statuses, lambda x: x.isin(*s))
    return F.when(has("EN", "CR"), 1).when(has("VU"), 2).when(has("NT"), 3)
