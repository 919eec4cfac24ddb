"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fieldqueue.llm.lean import few_rows, lean
from fieldqueue.llm.shared import kept
from fieldqueue.llm.wordhash import JOIN, mixed, pieces

#: Hash of the token that ends every text.
STOP = np.uint64(0x5851F42D4C957F2D)
#: Tokens gathered in a task before their counts are sent on; bits of the filter at most and at least, its regions and probes, and its bits for each item.
GATHER, FILTER_BITS, LEAST_BITS, REGIONS, PROBES, ROOM = 1 << 20, 1 << 29, 1 << 23, 256, 4, 10
#: Frequent tokens whose exact counts are broadcast, 16 bytes each, at most.
FREQUENT = 1 << 19
#: N-grams up to which several levels are probed at once, and how many; the bits of a byte.
FEW, TOGETHER, BIT = 1 << 12, 6, np.left_shift(1, np.arange(8)).astype(np.uint8)
#: Growth of the count levels; bytes of text whose counts make a bucket, about.
GROWTH, BUCKET = 1.25, 1 << 23


def count_levels() -> np.ndarray:
    """Smallest count of each level: 1, 2, 3, ... and from where that grows faster by a quarter each."""
    v = [1]
    while v[-1] < 2**48:
        v.append(max(v[-1] + 1, int(v[-1] * GROWTH)))
    return np.array(v, np.int64)


LEVELS = count_levels()
#: Count that stands for a level: between its smallest and largest.
VALUES = np.concatenate(([0.0], np.sqrt(LEVELS * np.append(LEVELS[1:] - 1, LEVELS[-1]).astype(float))))


def level(counts: np.ndarray) -> np.ndarray:
    """Number of levels up to a count; 0 for none."""
    return np.searchsorted(LEVELS, counts, "right")


def tokens_of(words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a run of texts, each with its end, and the place after each text's last."""
    return np.insert(words, before[1:], STOP), before[1:] + np.arange(1, len(before))


def pairs_of(tokens: np.ndarray) -> np.ndarray:
    """Hash of each token and the one before; a text's first follows an end."""
    last = np.concatenate(([STOP], tokens[:-1]))
    return mixed(last * np.uint64(JOIN) + tokens)


def narrow(pairs: np.ndarray) -> np.ndarray:
    """Pairs as they are counted: by 48 bits of their hash."""
    return pairs & np.uint64(2**48 - 1)


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    return ((narrow(grams) >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def packed_counts(buckets: int):
    """(bucket, n, grams, times): a task's token counts and pair counts of texts that are learned from, and as n = 3 the pairs of the others, sorted and cut by bucket of the hash; from rows (text, learn)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        others: list[np.ndarray] = []
        size = 0
        joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.uint64)

        def packed() -> pa.RecordBatch:
            rows = []
            for n, grams in ((1, joined(held)), (2, narrow(joined([pairs_of(t) for t in held]))), (3, narrow(joined([pairs_of(t) for t in others])))):
                grams, times = np.unique(grams, return_counts=True)
                times = times if n < 3 else times[:0]
                if n == 2:  # one byte holds a count; a larger one is several entries
                    more = (times - 1) // 255
                    times = np.concatenate((times - 255 * more, np.full(int(more.sum()), 255)))
                    grams = np.concatenate((grams, np.repeat(grams[more > 0], more[more > 0])))
                bucket = bucket_of(grams, buckets)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                low = grams.view(np.uint8).reshape(-1, 8)[order, : 8 if n == 1 else 6]
                times = times[order].astype(np.uint32 if n == 1 else np.uint8) if n < 3 else times
                rows += [(b, n, low[cut[b] : cut[b + 1]].tobytes(), times[cut[b] : cut[b + 1]].tobytes()) for b in range(buckets) if cut[b] < cut[b + 1]]
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["bucket", "n", "grams", "times"])

        for batch in batches:
            learn = np.asarray(batch.column(1).to_numpy(zero_copy_only=False)).astype(bool)
            for i, j, words, before in pieces(batch.column(0)):
                tokens, ends = tokens_of(words, before)
                mine = np.repeat(learn[i:j], np.diff(np.concatenate(([0], ends))))
                # whole texts on either side, so that pairs stay what they are
                held.append(tokens[mine])
                others.append(tokens[~mine])
                size += len(tokens)
                if size >= GATHER:
                    yield packed()
                    held, others, size = [], [], 0
        if held:
            yield packed()

    return lean(run)


def wide(low: bytes) -> np.ndarray:
    """Numbers of 64 bits from their lower six bytes each."""
    out = np.zeros((len(low) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(low, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def summed_counts(singles: bool):
    """(n, gram, times) of all tokens, of the pairs that occur twice or more, and as n = 3 of those that occur once and that a text asks for which isn't learned from; rows come sorted by bucket and n.

    With singles, only (n, bucket, grams) of all pairs that occur once.
    """
    names = ["n", "gram", "times", "bucket", "grams"]

    def found(n: int, gram: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(gram), 1 << 16):
            g, t = gram[k : k + (1 << 16)], times[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), n, np.int32)), pa.array(g.view(np.int64)), pa.array(t), pa.nulls(len(g), pa.int32()), pa.nulls(len(g), pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = np.zeros(0, np.uint64)

        def summed(bucket: int, n: int, parts: list) -> Iterator[pa.RecordBatch]:
            nonlocal once
            if n == 3:
                if not singles:
                    asked = np.unique(wide(b"".join(g for g, _ in parts)))
                    gram = asked[np.isin(asked, once, assume_unique=True)]
                    yield from found(3, gram, np.ones(len(gram), np.int64))
                return
            if n == 1:
                gram = np.concatenate([np.frombuffer(g, np.uint64) for g, _ in parts])
                times = np.concatenate([np.frombuffer(t, np.uint32) for _, t in parts])
            else:
                gram, times = wide(b"".join(g for g, _ in parts)), np.concatenate([np.frombuffer(t, np.uint8) for _, t in parts])
            order = np.argsort(gram, kind="stable")
            gram, times = gram[order], times[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
            gram, times = gram[first], np.add.reduceat(times, first)
            if n == 2:
                once = gram[times == 1]
                gram, times = gram[times > 1], times[times > 1]
            if not singles:
                yield from found(n, gram, times)
            elif n == 2:
                for k in range(0, len(once), 1 << 16):
                    low = once[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([bucket], pa.int32()), pa.array([low], pa.binary())], names)

        now, parts = None, []
        for batch in batches:
            for bucket, n, grams, times in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and (bucket, n) != now:
                    yield from summed(*now, parts)
                    parts = []
                    if bucket != now[0]:
                        once = np.zeros(0, np.uint64)
                now = (bucket, n)
                parts.append((grams, times))
        if parts:
            yield from summed(*now, parts)

    return lean(run)


def probes(gram: np.ndarray, n: int, j: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes of level j of an n-gram start, and their step; each below 2^32."""
    x = mixed(gram + np.uint64(n) + np.asarray(j, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return x >> np.uint64(32), (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)


def place(start: np.ndarray, step: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """Bit that a probe looks at, within the region of the n-gram."""
    size, x = np.uint64(bits // REGIONS), start + np.uint64(probe) * step
    return (x - x // size * size).view(np.int64)  # numpy divides by one number much faster than it takes remainders


def region(gram: np.ndarray) -> np.ndarray:
    return (mixed(gram ^ np.uint64(0x27D4EB2F165667C5)) % np.uint64(REGIONS)).view(np.int64)


@lean
def region_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region(np.asarray(batch.column(1)).view(np.uint64)).astype(np.int32))], [*batch.schema.names, "region"])


def region_bits(cutoff: dict[int, int], whole: int = FILTER_BITS):
    """(region, bits) of the regions, of a filter of `whole` bits, whose n-grams (n, gram, times, region) come, sorted by region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["region", "bits"])
        for batch in batches:
            n, gram, times, own = (np.asarray(c) for c in batch.columns)
            gram, top = gram.view(np.uint64), level(times)
            for r in np.unique(own).tolist():
                if r != now:
                    if now is not None:
                        yield out()
                    now, bits = r, np.zeros(whole // REGIONS, bool)
                for k in cutoff:
                    which = (own == r) & (n == k)
                    low = int(level(np.array(cutoff[k])))
                    count = top[which] - low + 1
                    g = np.repeat(gram[which], count)
                    j = low + np.arange(len(g)) - np.repeat(np.cumsum(count) - count, count)
                    start, step = probes(g, k, j)
                    for p in range(PROBES):
                        bits[place(start, step, p, whole)] = True
        if now is not None:
            yield out()

    return lean(run)


class LogFrequencyFilter:
    """Quantised counts of n-grams: an n-gram of level q is a member under each level from its order's cutoff to q."""

    def __init__(self, bits: np.ndarray, cutoff: dict[int, int]):
        self.bits, self.low = bits, {n: int(level(np.array(c))) for n, c in cutoff.items()}

    def levels(self, gram: np.ndarray, n: int) -> np.ndarray:
        """Level of each n-gram, found by probing level after level until one is no member; 0 if the first isn't. Few n-grams try TOGETHER levels at once."""
        out = np.zeros(len(gram), np.int64)
        at, base = np.arange(len(gram)), region(gram) * (8 * len(self.bits) // REGIONS)
        j = self.low[n]
        while len(at) and j <= len(LEVELS):
            if len(at) > FEW:
                start, step = probes(gram[at], n, j)
                for p in range(PROBES):
                    held = self.held(base[at] + place(start, step, p, 8 * len(self.bits)))
                    at, start, step = at[held], start[held], step[held]
                out[at] = j
                j += 1
                continue
            some = np.arange(j, min(j + TOGETHER, len(LEVELS) + 1))
            start, step = probes(gram[at, None], n, some[None, :])
            held = np.ones(start.shape, bool)
            for p in range(PROBES):
                held &= self.held(base[at, None] + place(start, step, p, 8 * len(self.bits)))
            reached = np.logical_and.accumulate(held, 1).sum(1)
            out[at] = np.where(reached > 0, j - 1 + reached, out[at])
            at, j = at[reached == len(some)], j + len(some)
        return out

    def held(self, where: np.ndarray) -> np.ndarray:
        return (self.bits[where >> 3] & BIT[where & 7]) != 0


class Model:
    """What scoring needs: N, V, frequent tokens and their exact counts, and the filter."""

    def __init__(self, total: int, distinct: int, frequent: np.ndarray, times: np.ndarray, bloom: LogFrequencyFilter, buckets: int):
        self.total, self.distinct, self.frequent, self.times, self.bloom, self.buckets = total, distinct, frequent, times, bloom, buckets

    def parts(self, tokens: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Levels of each token, the one before and their pair, 0 if the filter holds none, and the pair's hash. `learn` says of each token whether its text is learned from."""
        one, back = np.unique(tokens, return_inverse=True)
        own = self.bloom.levels(one, 1)[back]
        two, place = np.unique(pairs_of(tokens), return_inverse=True)
        level_of = self.bloom.levels(narrow(two), 2)
        asks = np.zeros(len(two), bool)
        asks[place[~learn]] = True
        asks &= level_of == 0
        once = np.zeros(len(two), np.int64)
        once[asks] = self.bloom.levels(narrow(two[asks]), 3)
        pair = np.where(learn, level_of[place], np.maximum(level_of, once)[place])
        first = int(self.bloom.levels(np.array([STOP]), 1)[0])
        before = np.concatenate(([first], own[:-1]))
        return own, before, pair, two[place]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column, and how many each row has."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)), np.diff(at)


def cut_up(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """Binary column whose rows have so many bytes each."""
    at = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(values.astype(np.uint8).tobytes())])


def triples(batch: pa.RecordBatch) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Levels (token, the one before, their pair) in the last three columns: distinct ones as a number each, their parts, and the place of each occurrence among them."""
    own, last, pair = (flat(c)[0].astype(np.int64) for c in batch.columns[-3:])
    code, back = np.unique(own << 16 | last << 8 | pair, return_inverse=True)
    return code, (code >> 16, code >> 8 & 255, code & 255), back


def tuning_rows(whole: int):
    """(level, ratio, times): how pair and single probability compare, each token left out of its own counts, from rows of levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            _, (own, last, pair), back = triples(batch)
            single = np.maximum(VALUES[own], 1.0) / whole
            given = np.maximum(VALUES[pair] - 1, 0) / np.maximum(VALUES[last] - 1, 1)
            ratio = np.where(given > 0, np.clip(np.rint(4 * np.log2(np.maximum(given, 1e-30) / single)), -200, 200), -1000).astype(np.int64)
            for a, r, t in zip(last.tolist(), ratio.tolist(), np.bincount(back, minlength=len(last)).tolist()):
                total[a, r] = total.get((a, r), 0) + t
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array(list(total.values()), pa.int64())], ["level", "ratio", "times"])

    return lean(run)


def interpolation(rows: list[tuple[int, int, int]]) -> np.ndarray:
    """Weight of the pair probability by level of the token before, by expectation-maximisation."""
    out = np.full(len(LEVELS) + 1, 0.1)
    for a in range(len(out)):
        own = [(2.0 ** (r / 4) if r > -1000 else 0.0, t) for k, r, t in rows if k == a]
        if own:
            ratio, times = np.array(own).T
            w = 0.1
            for _ in range(60):
                w = float((times * (w * ratio / (w * ratio + 1 - w))).sum() / times.sum())
            out[a] = min(max(w, 1e-4), 0.99)
    return out


def train(texts: DataFrame) -> tuple[Model, DataFrame, DataFrame | None]:
    """The model, the exact counts (gram, times) of all tokens, and the pairs below the filter's cutoff (bucket, grams, pair) with their levels, if there are any, from rows (text, learn)."""
    spark = texts.sparkSession
    few_rows(spark)
    buckets = max(1, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET))
    packed = texts.select("text", "learn").mapInArrow(packed_counts(buckets), "bucket int, n int, grams binary, times binary").repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "n")
    schema = "n int, gram long, times long, bucket int, grams binary"
    counts = kept(packed.mapInArrow(summed_counts(False), schema)).drop("bucket", "grams")
    singles = counts.where("n = 1").select("gram", "times")
    total, distinct = singles.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count("*")).first()
    seen = counts.groupBy("n", F.least("times", F.lit(100_000)).alias("c")).count().collect()
    # cutoffs: whatever the corpus, the items of all levels have ROOM bits each; what is below is joined
    cutoff = {1: 1, 2: 2, 3: 1}

    def items(n: int) -> int:
        low = int(level(np.array(cutoff[n])))
        return sum(r["count"] * (int(level(np.array(r["c"]))) - low + 1) for r in seen if r["n"] == n and r["c"] >= cutoff[n])

    while items(1) + items(2) + items(3) > FILTER_BITS // ROOM and max(cutoff.values()) < 2**40:
        # pairs that are asked for are joined with the rest as soon as any are
        cutoff[3] = 2
        cutoff[2 if cutoff[2] < 16 * cutoff[1] else 1] *= 2
    whole = max(LEAST_BITS, -(-(items(1) + items(2) + items(3)) * ROOM // (64 * REGIONS)) * 64 * REGIONS)
    used = counts.select("n", "gram", "times").where(F.col("times") >= F.element_at(F.create_map(*[F.lit(x) for kv in cutoff.items() for x in kv]), F.col("n")))
    regions = used.mapInArrow(region_column, "n int, gram long, times long, region int").repartition("region").sortWithinPartitions("region").mapInArrow(region_bits(cutoff, whole), "region int, bits binary").toArrow()
    size = whole // REGIONS // 8
    bits = np.zeros(whole // 8, np.uint8)
    for r, b in zip(regions.column("region").to_pylist(), regions.column("bits")):
        bits[r * size : (r + 1) * size] = np.frombuffer(b.as_buffer(), np.uint8)
    # the least count that FREQUENT tokens at most exceed
    least, so_far = 1, 0
    for r in sorted((r for r in seen if r["n"] == 1), key=lambda r: -r["c"]):
        so_far += r["count"]
        if so_far > FREQUENT:
            least = r["c"] + 1
            break
    often = singles.where(F.col("times") >= least).toArrow()
    gram = np.asarray(often.column("gram")).astype(np.int64).view(np.uint64)
    order = np.argsort(gram)
    model = Model(int(total), int(distinct), gram[order], np.asarray(often.column("times"))[order], LogFrequencyFilter(bits, cutoff), buckets)
    if cutoff[2] == 2:
        return model, singles, None
    below = counts.where((F.col("n") == 2) & (F.col("times") < cutoff[2])).select("gram", "times", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("grams"))
    once = packed.mapInArrow(summed_counts(True), schema).select("gram", "times", "bucket", "grams")
    return model, singles, below.unionByName(once).mapInArrow(few_pairs(buckets), "bucket int, grams binary, pair binary")


def few_pairs(buckets: int):
    """(bucket, grams, levels) of rows (gram, times), or (bucket, grams) of pairs that occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for b, g in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if g is not None:
                    rows.append((b, g, np.ones(len(g) // 6, np.uint8).tobytes()))
            some = batch.filter(batch.column(0).is_valid())
            if some.num_rows:
                gram, top = np.asarray(some.column(0)).view(np.uint64), level(np.asarray(some.column(1))).astype(np.uint8)
                own = bucket_of(gram, buckets)
                order = np.argsort(own, kind="stable")
                found, first = np.unique(own[order], return_index=True)
                for b, i, j in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
                    rows.append((b, gram[order[i:j]].view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), top[order[i:j]].tobytes()))
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["bucket", "grams", "pair"])

    return lean(run)


def table(columns: dict[str, pa.Array], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    """A batch of these columns, null where there is none."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in kinds.items()], list(kinds))


def asked(kinds: dict[str, pa.DataType], key: int | None, docs: np.ndarray, learn: np.ndarray, own: np.ndarray, last: np.ndarray, pair: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Occurrences of pairs whose count is to be joined, by bucket of the hash: documents (from key on, or keys if that is null), levels of both tokens, and hashes."""
    code = bucket_of(pair, buckets) * 2 + learn
    order = np.argsort(code, kind="stable")
    found, first = np.unique(code[order], return_index=True)
    low = pair.view(np.uint8).reshape(-1, 8)[order, :6]
    parts = [np.ascontiguousarray(x) for x in (docs[order], own[order].astype(np.uint8), last[order].astype(np.uint8), low)]
    cut = list(zip(first.tolist(), [*first[1:].tolist(), len(order)]))
    docs, own, last, low = (pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in parts)
    n = len(cut)
    return table({"kind": pa.array([PAIRS] * n, pa.int32()), "key": pa.array([key] * n, pa.int64()), "learn": pa.array((found & 1).astype(bool)), "bucket": pa.array((found >> 1).astype(np.int32)), "docs": docs, "own": own, "last": last, "grams": low}, kinds)


#: Kinds of rows: a document; a token of it that isn't frequent; pairs to be joined; a pair one of whose tokens is to be joined first.
DOCUMENT, TOKEN, PAIRS, UNKNOWN = range(4)


def looked_up(model, kinds: dict[str, pa.DataType]):
    """From rows (doc_id, text, learn), for each text a DOCUMENT with the levels of what the filter holds, TOKEN rows for its tokens that aren't frequent, and PAIRS and UNKNOWN rows for what is below the cutoffs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        key = start = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        # a pair of a training document that isn't in a filter of all pairs that occur twice occurs once
        once, all_tokens = m.bloom.low[2] == 2, m.bloom.low[1] == 1

        def gathered() -> pa.RecordBatch:
            return asked(kinds, start, *(np.concatenate(x) for x in zip(*held)), m.buckets)

        for batch in batches:
            learns = np.asarray(batch.column(2).to_numpy(zero_copy_only=False)).astype(bool)
            for i, j, words, before in pieces(batch.column(1)):
                if held and (key + j - i - start > 1 << 16 or sum(len(h[0]) for h in held) >= GATHER):
                    yield gathered()
                    held = []
                if not held:
                    start = key
                tokens, ends = tokens_of(words, before)
                doc = np.repeat(np.arange(j - i), np.diff(np.concatenate(([0], ends))))
                one, back = np.unique(tokens, return_inverse=True)
                if len(m.frequent):
                    at = np.minimum(np.searchsorted(m.frequent, one), len(m.frequent) - 1)
                    times = np.where(m.frequent[at] == one, m.times[at], 0)
                else:
                    times = np.zeros(len(one), np.int64)
                hot, base = times[back] > 0, np.log10((times + 1) / (m.total + m.distinct + 1))[back]
                learn = learns[i:j][doc]
                own, last, pair, hashes = m.parts(tokens, learn)
                unknown = np.zeros(len(tokens), bool) if all_tokens else (pair == 0) & ((own == 0) | (last == 0))
                if once:
                    pair = np.where((pair == 0) & learn & ~unknown, 1, pair)
                # and what others ask for is in the filter too
                ask = (pair == 0) & (own > 0) & (last > 0) & (not once)
                done = ~ask & ~unknown
                count = lambda w=None: np.bincount(doc, w, minlength=j - i)
                n = j - i
                keys, size = np.arange(key, key + n), count(done.astype(float)).astype(np.int64)
                yield table({
                    "kind": pa.array(np.full(n, DOCUMENT, np.int32)), "key": pa.array(keys), "doc_id": batch.column(0).slice(i, n), "learn": pa.array(learns[i:j]), "n_tokens": pa.array(count()), "n_known": pa.array(count(hot.astype(float)).astype(np.int64)), "base": pa.array(count(np.where(hot, base, 0.0))),
                    "own": cut_up(own[done], size), "last": cut_up(last[done], size), "pair": cut_up(pair[done], size),
                }, kinds)
                if not hot.all():
                    both, times = unique_pairs(doc[~hot], back[~hot], len(one))
                    yield table({"kind": pa.array(np.full(len(times), TOKEN, np.int32)), "key": pa.array(keys[both[0]]), "gram": pa.array(one[both[1]].view(np.int64)), "times": pa.array(times)}, kinds)
                if unknown.any():
                    # a token that is known meets nothing, under a hash that spreads
                    before_ = np.concatenate(([STOP], tokens[:-1]))
                    side = lambda lev, gram: pa.array(np.where(lev > 0, hashes, gram)[unknown].view(np.int64))
                    k = int(unknown.sum())
                    yield table({
                        "kind": pa.array(np.full(k, UNKNOWN, np.int32)), "key": pa.array(keys[doc[unknown]]), "learn": pa.array(learn[unknown]), "gram": pa.array(narrow(hashes[unknown]).view(np.int64)),
                        "own": cut_up(own[unknown], np.ones(k, int)), "last": cut_up(last[unknown], np.ones(k, int)), "own_gram": side(own, tokens), "last_gram": side(last, before_),
                    }, kinds)
                if ask.any():
                    held.append(((key - start + doc[ask]).astype(np.uint16), learn[ask], own[ask].astype(np.uint8), last[ask].astype(np.uint8), hashes[ask]))
                key += n
        if held:
            yield gathered()

    return lean(run)


def now_known(kinds: dict[str, pa.DataType], buckets: int):
    """PAIRS from rows (key, learn, gram, own, last, own_times, last_times), the levels of unknown tokens filled in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key, gram = np.asarray(batch.column(0)), np.asarray(batch.column(2)).view(np.uint64)
                learn = np.asarray(batch.column(1).to_numpy(zero_copy_only=False)).astype(bool)
                own, last = (np.where(flat(batch.column(c))[0] > 0, flat(batch.column(c))[0], level(np.asarray(batch.column(c + 2)))) for c in (3, 4))
                yield asked(kinds, None, key, learn, own, last, gram, buckets)

    return lean(run)


@lean
def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, learn, docs, own, last, pair) for PAIRS; rows (bucket, kind, grams, pair, key, learn, docs, own, last) come sorted by bucket, its counts first."""
    now, parts, gram, top = None, [], None, None
    for batch in batches:
        out = []
        for bucket, kind, grams, pair, key, learn, docs, own, last in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now:
                now, parts, gram = bucket, [], None
            if kind == 0:
                parts.append((grams, pair))
                continue
            if gram is None:
                gram = wide(b"".join(g for g, _ in parts))
                order = np.argsort(gram)
                gram, top, parts = gram[order], np.frombuffer(b"".join(p for _, p in parts), np.uint8)[order], []
            mine, found = wide(grams), np.zeros(len(own), np.uint8)
            if len(gram):
                at = np.minimum(np.searchsorted(gram, mine), len(gram) - 1)
                found = np.where(gram[at] == mine, top[at], 0).astype(np.uint8)
            out.append((key, learn, docs, own, last, found.tobytes()))
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.bool_()), *(pa.array(c, pa.binary()) for c in cols[2:])], ["key", "learn", "docs", "own", "last", "pair"])


def level_scores(levels: tuple[np.ndarray, np.ndarray, np.ndarray], weight: np.ndarray, whole: int) -> np.ndarray:
    """log10 of a token's probability, by the levels of it, the one before and their pair."""
    own, last, pair = levels
    w = weight[last]
    return np.log10(w * np.minimum(1.0, VALUES[pair] / np.maximum(VALUES[last], 1.0)) + (1 - w) * (VALUES[own] + 1) / (whole + 1))


def scored_rows(weight: np.ndarray, whole: int):
    """(key, score) of rows (key, docs, own, last, pair): of a document if docs is null, or of each document in docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, levels, back = triples(batch)
            each = level_scores(levels, weight, whole)[back]
            size = flat(batch.column(2))[1]
            docs, keys = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            own = [np.full(n, k) if d is None else np.frombuffer(d, np.int64) if k is None else k + np.frombuffer(d, np.uint16).astype(np.int64) for k, d, n in zip(keys, docs, size.tolist())]
            key, place = np.unique(np.concatenate([np.array([k for k, d in zip(keys, docs) if d is None], np.int64), *own]), return_inverse=True)
            none = len(place) - len(each)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(place[none:], each, minlength=len(key)).astype(float))], ["key", "score"])

    return lean(run)


def unique_pairs(a: np.ndarray, b: np.ndarray, size: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct (a, b), b below size, and how often each occurs."""
    both, times = np.unique(a.astype(np.int64) * size + b, return_counts=True)
    return (both // size, both % size), times


def joined_pairs(rows: DataFrame, singles: DataFrame, few: DataFrame, model: Model, kinds: dict[str, pa.DataType], schema: str) -> DataFrame:
    """(key, learn, docs, own, last, pair) of the pairs that looked_up() has left to a join by hash."""
    pairs = rows.where(F.col("kind") == PAIRS)
    if model.bloom.low[1] > 1:
        counted = lambda side: singles.select(F.col("gram").alias(f"{side}_gram"), F.col("times").alias(f"{side}_times"))
        open_ = rows.where(F.col("kind") == UNKNOWN).select("key", "learn", "gram", "own", "last", "own_gram", "last_gram").join(counted("own"), "own_gram", "left").join(counted("last"), "last_gram", "left")
        open_ = open_.select("key", "learn", "gram", "own", "last", F.coalesce("own_times", F.lit(0)).alias("own_times"), F.coalesce("last_times", F.lit(0)).alias("last_times"))
        pairs = pairs.unionByName(open_.mapInArrow(now_known(kinds, model.buckets), schema))
    columns = ["bucket", "kind", "grams", "pair", "key", "learn", "docs", "own", "last"]
    both = few.withColumn("kind", F.lit(0)).unionByName(pairs.select(columns).drop("pair"), allowMissingColumns=True).select(columns)
    return kept(both.repartitionById(model.buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind").mapInArrow(answered, "key long, learn boolean, docs binary, own binary, last binary, pair binary"))


def language_model_scores(docs: DataFrame, training: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document; `training` says which are learned from.

    Tokens are words, A-Z as a-z, and one end a text, known by 64-bit hashes. Counts of tokens and pairs are
    summed by hash over all training documents. Quantised on a logarithmic scale they fill a Bloom filter that has
    ROOM bits for each item, so that its error doesn't grow with the corpus; it is broadcast, and probing level after
    level gives a count back. Pairs that occur once are items only if a document asks for them that isn't learned from:
    in one that is, a pair that the filter lacks occurs once. A filter that would exceed FILTER_BITS leaves out what
    is below cutoffs, and the levels of that are joined by hash, so that the bound decides only what is broadcast. A token's probability is interpolated from
    its pair's and its own, with weights by frequency of the token before that leave-one-out estimation on
    all training documents sets.

    base_score and n_known are exact: counts of the FREQUENT most frequent tokens are broadcast, those of the
    others joined by hash. Null and empty texts are an end alone. Null ids aren't learned from. Rows of one id
    each come back. Empty table: no rows. Other columns are ignored.
    """
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("learn"))
    model, singles, few = train(d.select(F.coalesce("text", F.lit("")).alias("text"), "learn"))
    kind, size = d.schema["doc_id"].dataType.simpleString(), model.total + model.distinct
    schema = f"kind int, key long, doc_id {kind}, learn boolean, n_tokens long, n_known long, base double, own binary, last binary, pair binary, bucket int, docs binary, grams binary, gram long, times long, own_gram long, last_gram long"
    empty = d.sparkSession.createDataFrame([], schema)
    kinds = {f.name: f.type for f in to_arrow_schema(empty.schema)}
    rows = kept(d.select("doc_id", "text", "learn").mapInArrow(looked_up(d.sparkSession.sparkContext.broadcast(model), kinds), schema))
    levels = rows.where(F.col("kind") == DOCUMENT).select("key", "learn", "docs", "own", "last", "pair")
    if few is not None:
        levels = levels.unionByName(joined_pairs(rows, singles, few, model, kinds, schema))
    ratios = levels.where("learn").select("own", "last", "pair").mapInArrow(tuning_rows(size), "level int, ratio int, times long").groupBy("level", "ratio").agg(F.sum("times")).collect()
    scores = levels.select("key", "docs", "own", "last", "pair").mapInArrow(scored_rows(interpolation([tuple(r) for r in ratios]), size), "key long, score double").groupBy("key").agg(F.sum("score").alias("score"))
    whole = F.lit(float(model.total + model.distinct + 1))
    rest = rows.where(F.col("kind") == TOKEN).select("key", "gram", F.col("times").alias("own")).join(singles, "gram", "left")
    rest = rest.groupBy("key").agg(F.sum(F.col("own") * F.log10((F.coalesce("times", F.lit(0)) + 1) / whole)).alias("more"), F.sum(F.when(F.col("times").isNotNull(), F.col("own")).otherwise(0)).alias("known"))
    out = rows.where(F.col("kind") == DOCUMENT).select("key", "doc_id", "n_tokens", "n_known", "base").join(rest, "key", "left").join(scores, "key")
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")


def op4_language_model(docs: DataFrame) -> DataFrame:
    """Scores of all documents, learned from those whose crc32(doc_id) modulo 7 is not 2."""
    part = F.crc32(F.col("doc_id").cast("string")) % 7
    out = language_model_scores(docs, part != 2)
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
