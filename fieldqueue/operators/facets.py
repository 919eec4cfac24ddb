"""Filters that combine by facet: or within one, and across, not taken away."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(True)


def keep(groups: list[str], left_out: list[str], taxa: list[Column], group: str = "grp") -> Column:
    """Rows of a picked group or taxon, less the groups left out; with nothing picked all but those."""
    picked = ([F.col(group).isin(groups)] if groups else []) + taxa
    return any_of(picked) & (~F.col(group).isin(left_out) if left_out else F.lit(True))


def dates(column: str, first: date | None, last: date | None, months: int = 0xFFF) -> Column:
    """Days from first to last, swapped if need be, in the months of a 12-bit mask. An undated row fails any limit."""
    if first and last and first > last:
        first, last = last, first
    limits = [F.col(column) >= F.lit(first)] if first else []
    limits += [F.to_date(column) <= F.lit(last)] if last else []
    if months & 0xFFF != 0xFFF:
        limits.append(F.expr(f"(shiftleft(1, month({column}) - 1) & {months})") != 0)
    return F.coalesce(reduce(lambda a, b: a & b, limits), F.lit(False)) if limits else F.lit(True)


def bits(required: int, hidden: int, flags: Column) -> Column:
    """All required flags set, none of the hidden ones."""
    return (flags.bitwiseAND(F.lit(required)) == required) & (flags.bitwiseAND(F.lit(hidden)) == 0)


def nibble(x: Column) -> Column:
    """A count from 0 to 15."""
    return F.least(F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)), F.lit(15)).cast("int")


def one_short(agree: Column, n: Column) -> Column:
    """One more agreeing vote would pass two thirds."""
    return 3 * (agree + 1) > 2 * (n + 1)
