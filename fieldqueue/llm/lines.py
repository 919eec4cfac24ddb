"""Removal of repeated passages by overlapping three-line windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window.
WINDOW = 3


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with `text` cleaned, plus n_lines and n_removed (long): a line goes if a later occurrence of a repeated window covers it.

    Lines end at line feeds and compare without the white space around them. Every three consecutive lines of
    which one at least isn't blank are a window. Of equal windows anywhere in the table the one of the smallest
    (doc_id, place) stays; the lines that any other covers are removed, overlapping windows as one. The first
    copy of every removed line stays, since each points to an earlier one.

    Texts with fewer lines than a window, empty and null texts stay as they are. A null id comes before all
    others. Rows of one id and text are one document: each comes back, cleaned alike. Empty table: no rows.
    All columns of docs come back, but n_lines and n_removed give way; none but doc_id and text is read.

    Only hashes travel: sums by window find the repeated ones, a join marks the later places, and a second join
    by document brings these to the text. A window that a third of all documents hold is one row a task before
    the shuffle, and its places are a join that may be split.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    d = d.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(2**63))).alias("did"), F.xxhash64(F.col("row.text")).alias("key"))
    lines = d.select("did", "key", F.transform(F.split("row.text", "\n"), lambda x: F.trim(F.translate(x, "\t\r\x0b\x0c", "    "))).alias("l")).where(F.size("l") >= WINDOW)
    at = lambda i, k: F.get("l", i + k)
    window = lambda i: F.struct(i.alias("pos"), F.xxhash64(*[at(i, k) for k in range(WINDOW)]).alias("h1"), F.xxhash64(F.lit(7), *[at(i, k) for k in range(WINDOW)]).alias("h2"), (F.length(at(i, 0)) + F.length(at(i, 1)) + F.length(at(i, 2)) > 0).alias("some"))
    w = lines.select("did", "key", F.explode(F.transform(F.sequence(F.lit(0), F.size("l") - WINDOW), window)).alias("w")).where("w.some").select("did", "key", "w.pos", "w.h1", "w.h2")
    place = F.struct("did", "key", "pos")
    firsts = w.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") != F.col("last")).select("h1", "h2", "first")
    later = w.join(firsts, ["h1", "h2"]).where(place > F.col("first")).groupBy("did", "key").agg(F.collect_set("pos").alias("late"))
    covered = F.array_distinct(F.flatten(F.transform("late", lambda p: F.array(p, p + 1, p + 2))))
    left = F.array_except(F.sequence(F.lit(0), F.size("raw") - 1), covered)
    cleaned = F.array_join(F.transform(left, lambda i: F.get("raw", i)), "\n")
    out = d.join(later, ["did", "key"], "left").withColumn("raw", F.split("row.text", "\n"))
    gone = F.coalesce(F.size(covered), F.lit(0)).cast("long")
    return out.select(
        *[(F.when(F.col("late").isNull(), F.col("row.text")).otherwise(cleaned) if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in names],
        F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(F.size("raw")).cast("long").alias("n_lines"),
        F.when(F.col("late").isNull(), F.lit(0).cast("long")).otherwise(gone).alias("n_removed"),
    )


def op3_line_windows(docs: DataFrame) -> DataFrame:
    """Every document's cleaned text and the number of its lines before and of those removed."""
    return line_dedup(docs.select("doc_id", "text"))


ORACLE = r"""
with d as (select doc_id, text, string_split(text, chr(10)) raw from documents),
l as (select doc_id, text, raw, list_transform(raw, lambda x: trim(translate(x, chr(9) || chr(13) || chr(11) || chr(12), '    '))) ls from d),
w as (select doc_id, unnest(range(0, len(ls) - 2)) pos, ls from l where len(ls) >= 3),
k as (select doc_id, pos, ls[pos + 1] a, ls[pos + 2] b, ls[pos + 3] c from w where length(ls[pos + 1]) + length(ls[pos + 2]) + length(ls[pos + 3]) > 0),
f as (select *, row_number() over (partition by a, b, c order by doc_id, pos) n from k),
g as (select doc_id, list_distinct(flatten(list([pos, pos + 1, pos + 2]))) gone from f where n > 1 group by 1)
select l.doc_id, case when gone is null then text else array_to_string([raw[i + 1] for i in range(0, len(raw)) if not list_contains(gone, i)], chr(10)) end "text",
       coalesce(len(raw), 0)::BIGINT n_lines, coalesce(len(gone), 0)::BIGINT n_removed
from l left join g on l.doc_id = g.doc_id"""
