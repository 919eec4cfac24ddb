"""Tables kept in the folder that driver and executors share, and what is left without them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldqueue.sources.shared import kept

#: Ids that are broadcast at most, 8 bytes each.
FEW = 1 << 20


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id isn't in the one column of ids, null being an id. Few ids are broadcast, so that texts stay where they are; more are joined."""
    ids = kept(ids.toDF("_gone").distinct())
    if ids.count() <= FEW:
        ids = F.broadcast(ids)
    return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids["_gone"]), "left_anti")
