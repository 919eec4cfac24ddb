"""All queries of the engine, and the SQL that gives the same rows."""

from __future__ import annotations

from fieldqueue.plans import batching, bundles, clades, counting, experiments, indexing, inference, lists, outcomes, overturns, places, relations, reviews, similarity, steps, summaries, surprises, upkeep

MODULES = (batching, bundles, clades, counting, experiments, indexing, inference, lists, outcomes, overturns, places, relations, reviews, similarity, steps, summaries, surprises, upkeep)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
