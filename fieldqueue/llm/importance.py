"""Target-distribution importance resampling: array-scored weights, ranks by parallel sorting by regular sampling."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldqueue.llm.bytewords import grams, raw_texts
from fieldqueue.llm.lean import lean
from fieldqueue.llm.shared import kept

#: Buckets of features; words that a worker remembers the bucket of.
BUCKETS, REMEMBERED = 10_000, 1 << 18
#: Regular samples that the driver sorts at most, ranges at most, rows of a range at which there are fewer ranges.
SAMPLES, RANGES, ROWS = 1 << 16, 8192, 1 << 14


class Places(dict):
    """The bucket of a feature, remembered."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = place = crc32(feature) % self.buckets
        return place


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features in each bucket over all texts (one column), added up in a task before BUCKETS sums of each are shuffled."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, place = np.zeros(buckets, np.int64), Places(buckets)
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                for features in grams(raw, longest):
                    found = Counter(features)
                    np.add.at(total, np.fromiter(map(place.__getitem__, found), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of B buckets, in doubles."""
    b = len(source)
    s, t = float(source.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000 * math.log((float(y) + 1) * s / ((float(x) + 1) * t))) for x, y in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of rows (doc_id, text): the floored mean of the gains of a text's features, looked up as an array."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        place = Places(len(gain))
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for i, raw in enumerate(raw_texts(batch.column(1))):
                for k, features in enumerate(grams(raw, longest)):
                    out[0, i] += 0 if k % longest else len(features)
                    out[1, i] += len(features)
                    out[2, i] += gain[np.fromiter(map(place.__getitem__, features), np.int64, len(features))].sum()
            out[2] //= np.maximum(out[1], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in out)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) of a number u that only seed and id decide: the Gumbel draw that makes the highest scores a sample without replacement."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


Key = tuple[int, float, int, int]


def key(score: int, doc_id: int | None, row: int) -> Key:
    """Sorts as the ranking does: highest score first, then smaller id, null last, then the row."""
    return (-score, doc_id is None, doc_id or 0, row)


def ordering() -> list[Column]:
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row").asc()]


def splitters(rows: DataFrame, n: int) -> list[Key]:
    """Regular splitters of n rows (score, doc_id, _row): each task sorts its own and hands over every step-th; of these, sorted, every so-many-th is one.

    There are at most SAMPLES samples, whatever n is; a range between splitters has at most
    n / ranges rows and a step from each task.
    """
    step = max(1, n // SAMPLES)

    def regular(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            at = np.arange((step - 1 - seen) % step, batch.num_rows, step)
            seen += batch.num_rows
            yield batch.take(pa.array(at))

    sample = sorted(key(*r) for r in rows.sortWithinPartitions(*ordering()).mapInArrow(regular, rows.schema).collect())
    ranges = max(1, min(RANGES, n // ROWS, len(sample)))
    return [sample[i * len(sample) // ranges] for i in range(1, ranges)]


def ranged(rows: DataFrame, cuts: list[Key]) -> DataFrame:
    """Adds to rows (score, doc_id, _row, ...) the range between the splitters that they lie in."""
    shared = rows.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        first = np.array([c[0] for c in cuts], np.int64)
        for batch in batches:
            score, ids, row = (batch.column(c) for c in ("score", "doc_id", "_row"))
            s = -score.to_numpy()
            place = np.searchsorted(first, s)
            # only rows whose score is a splitter's need more than the score
            same = np.flatnonzero(place < np.searchsorted(first, s, "right"))
            place[same] = [bisect_left(cuts, key(*x)) for x in zip((-s[same]).tolist(), ids.take(pa.array(same)).to_pylist(), row.take(pa.array(same)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.astype(np.int32))], [*batch.schema.names, "_range"])

    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", _range int")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, least: int = 20, seed: int = 2024, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document (doc_id, text), drawn to resemble `target` (text).

    Features are runs of 1 to `longest` words, hashed into buckets; a document's weight is the floored mean of
    its features' gains (see gains), without features 0; with Gumbel noise by id added, the highest scores are a
    sample without replacement. Of documents with `least` words or more, `percent` % are drawn and ranked
    from 1: highest score first, then smaller id, null last; other documents have no rank.

    Ranks come without a sort of the whole: tasks sort their own rows and hand over regular samples, whose
    splitters part the order in ranges; counts of ranges give the places before each; only ranges
    that reach into the draw are exchanged and sorted. Rows are told apart by their place in the written table, so that equal
    ones, or a third of all rows under one id, are parted like any others.

    Null texts have no features. Null ids draw as the text 'null'. Repeated rows are documents of their own. Long texts
    are read whole, in pieces. Empty documents: no rows; empty target: every gain comes from t = 0. Other columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    gain = gains(bucket_counts(d.select("text"), longest, buckets), bucket_counts(target.select("text"), longest, buckets))
    base = weighed(d, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    base = kept(base.withColumn("_row", F.monotonically_increasing_id()))
    fit = F.col("n_words") >= least
    n = base.where(fit).count()
    wanted = percent * n // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    placed = ranged(base.where(fit).select(*columns, "_row"), splitters(base.where(fit).select("score", "doc_id", "_row"), n))
    before, starts = 0, []
    for r in sorted(placed.groupBy("_range").count().collect()):
        starts.append((r["_range"], before))
        before += r["count"]
    reached = max((i for i, b in starts if b < wanted), default=-1)
    inside, outside = placed.where(F.col("_range") <= reached), placed.where(F.col("_range") > reached)
    start = F.broadcast(docs.sparkSession.createDataFrame(starts, "_range int, _before long"))  # one row a range
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*ordering()))
    rank = F.col("_before") + within
    inside = inside.join(start, "_range").withColumn("rank", rank).select(*columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    rest = base.where(~fit).select(*columns).unionByName(outside.select(*columns))
    return inside.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def op11_importance_resampling(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A tenth of the documents, drawn to resemble the benchmark's words."""
    return resample(docs, benchmark)


ORACLE = r"""
with d as (select doc_id, row_number() over () r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
dw as (select r, f, count(*) n from (select r, unnest(w) f from d) group by 1, 2),
bw as (select f, count(*) n from (select unnest(w) f from b) group by 1),
step as (select list(c order by i) t from (select i, list_reduce(list_prepend(i, range(8)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) c from range(256) s(i))),
v as (select f, list_transform(range(octet_length(encode(f))), lambda j: ('0x' || substr(hex(encode(f)), 2 * j + 1, 2))::BIGINT) bytes from (select f from dw union select f from bw)),
c as (select f, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 k from v, step),
s as (select k, sum(n)::BIGINT s from dw join c using (f) group by 1),
t as (select k, sum(n)::BIGINT t from bw join c using (f) group by 1),
g as (select k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((select coalesce(sum(s), 0) from s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((select coalesce(sum(t), 0) from t) + 10000)::DOUBLE)))::BIGINT gain
      from s full join t using (k)),
w as (select r, sum(n)::BIGINT n, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT weight from dw join c using (f) join g using (k) group by 1),
x as (select doc_id, d.r, coalesce(n, 0) n_features, coalesce(weight, 0) weight, coalesce(weight, 0) +
             floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT score from d left join w on d.r = w.r),
o as (select r, row_number() over (order by score desc, doc_id nulls last, r) place, count(*) over () n from x where n_features >= 20)
select doc_id, n_features, weight, score, case when place <= 10 * n // 100 then place end "rank" from x left join o on x.r = o.r"""
