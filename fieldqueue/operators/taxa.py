"""Taxa of a pool: trees filled up to the root, and the table of names with the row of each one's parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldqueue.operators.ordering import ranked
from fieldqueue.sources.shared import kept

#: Taxa that a table holds at most whose rows are numbered by 16 bits.
MOST = 65_535
TREE = ["taxon_id", "parent", "latin", "common", "rank"]


def filled(tree: DataFrame, wanted: DataFrame, source: DataFrame) -> DataFrame:
    """The tree (TREE) with the wanted taxa (taxon_id) that it lacks and all their ancestors, looked up in `source` (TREE), each id asked for once.

    Rounds look up what is still missing, the parents of what the last one found, until there is none that hasn't been asked for. An id
    that the source lacks stays a gap. Of repeated ids the tree's row counts before the source's.
    """
    once = lambda d: d.where("taxon_id is not null").groupBy("taxon_id").agg(F.first(F.struct(*TREE[1:])).alias("r")).select("taxon_id", "r.*")
    have = kept(once(tree.select(TREE)))
    asked = have.select("taxon_id")
    need = wanted.select("taxon_id").unionByName(have.select(F.col("parent").alias("taxon_id")))
    rows = [have]
    while True:
        need = kept(need.where("taxon_id is not null").distinct().join(asked, "taxon_id", "left_anti"))
        if need.isEmpty():
            break
        asked = asked.unionByName(need)
        found = kept(once(source.select(TREE).join(need, "taxon_id", "left_semi")))
        rows.append(found)
        need = found.select(F.col("parent").alias("taxon_id"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def taxa_table(records: DataFrame, tree: DataFrame | None = None, most: int | None = None) -> tuple[DataFrame, bool]:
    """(row, taxon_id, latin, common, rank, parent, own): the taxa of records (taxon_id, taxon_name, common_name, rank), commonest first, then smaller id, with the row of each one's parent, -1 for none; and whether the tree holds the whole line of each.

    With a tree (TREE), ancestors that no record bears follow by id, with none of their own. A line that runs into a gap or a ring is
    not whole, and what stands above the gap isn't added. Rows are numbered as far as there are taxa; with `most` (MOST for rows
    of 16 bits), so many or more are an error.
    """
    named = records.where("taxon_id is not null")
    text = lambda c: F.coalesce(F.first(c, ignorenulls=True), F.lit(""))
    own = kept(named.groupBy("taxon_id").agg(text("taxon_name").alias("latin"), text("common_name").alias("common"), text("rank").alias("rank"), F.count("*").alias("own")))
    extra, complete = None, False
    if tree is not None:
        nodes = kept(tree.select(TREE).groupBy("taxon_id").agg(F.first(F.struct(*TREE[1:])).alias("r")).select("taxon_id", "r.*"))
        at = kept(own.select("taxon_id").distinct())
        seen, whole = [at], True
        reached = at
        while not at.isEmpty():
            up = kept(at.join(nodes.select("taxon_id", "parent"), "taxon_id", "left").select("taxon_id", "parent", F.col("parent").isNull().alias("_end")))
            whole = whole and at.join(nodes.select("taxon_id"), "taxon_id", "left_anti").isEmpty()
            parents = up.where("parent is not null").select(F.col("parent").alias("taxon_id")).distinct()
            at = kept(parents.join(reached, "taxon_id", "left_anti"))
            reached = reached.unionByName(at)
            seen.append(at)
        above = reached.join(nodes, "taxon_id").join(own.select("taxon_id"), "taxon_id", "left_anti")
        extra = above.select("taxon_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("latin", "common", "rank")], F.lit(0).cast("long").alias("own"))
        # a ring never reaches a root: what the roots lead down to must be all that was reached
        down = kept(reached.join(nodes.where("parent is null").select("taxon_id"), "taxon_id"))
        found = down
        while not down.isEmpty():
            down = kept(nodes.join(reached, "taxon_id").join(down.select(F.col("taxon_id").alias("parent")), "parent", "left_semi").select("taxon_id"))
            found = found.unionByName(down)
        complete = whole and own.join(found.distinct(), "taxon_id", "left_anti").isEmpty()
    rows = own.withColumn("_last", F.lit(0))
    if extra is not None:
        rows = rows.unionByName(extra.withColumn("_last", F.lit(1)))
    if most is not None and (n := rows.count()) >= most:
        raise ValueError(f"{n} taxa where less than {most} fit")
    placed = kept(ranked(rows, [], [F.col("_last").asc(), F.col("own").desc(), F.col("taxon_id").asc()], "row"))
    if tree is None:
        return placed.select("row", "taxon_id", "latin", "common", "rank", F.lit(-1).cast("long").alias("parent"), "own"), False
    up = placed.join(nodes.select("taxon_id", F.col("parent").alias("_p")), "taxon_id", "left")
    up = up.join(placed.select(F.col("taxon_id").alias("_p"), F.col("row").alias("_r")), "_p", "left")
    return up.select("row", "taxon_id", "latin", "common", "rank", F.coalesce("_r", F.lit(-1)).alias("parent"), "own"), complete
