"""Benchmark decontamination by templates: typed placeholders for numbers, units and names, and slots that must agree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldqueue.llm.lean import few_rows, lean
from fieldqueue.llm.shared import kept
from fieldqueue.llm.wordhash import JOIN, mixed

#: Tokens in a template window; of these at least so many plain words; share of an item's tokens, or number of them, that windows must cover.
WINDOW, PLAIN, COVER, LONG = 8, 4, 0.5, 13
#: Items of fewer tokens than FEWEST match as they are. Shorter items than a window are one window.
FEWEST = 5
#: Bits of the filter of the items' windows; tokens remembered by a worker; tokens handled at once.
FILTER_BITS, MEMO, PIECE = 1 << 24, 1 << 19, 1 << 17
# Words for numbers and units.
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds lb lbs ml l liter liters litre litres gallon gallons "
    "s sec second seconds minute minutes hour hours day days week weeks month months year years mph kph km/h m/s percent dollar dollars euro euros cent cents usd eur degrees celsius fahrenheit".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*%?$")
QUANTITY = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*([a-z/]+)$")
EDGES = ".,;:!?\"'()[]{}<>|*#&%$«»“”„…-–—`~^_=+/\\"
#: Kinds of tokens and what stands for them.
PLAIN_WORD, NUMBER_SLOT, UNIT_SLOT, NAME_SLOT = 0, 1, 2, 3


class Tokens(dict):
    """What is known of each distinct token: its place in the arrays. They start afresh when they are full."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.bare: list[str] = []
        self.hash = np.zeros(MEMO, np.uint64)
        self.kind = np.zeros(MEMO, np.int8)
        self.capital, self.ends, self.marks = (np.zeros(MEMO, bool) for _ in range(3))

    def __missing__(self, token: str) -> int:
        bare = token.strip(EDGES)
        low = bare.lower()
        self[token] = i = len(self.bare)
        if i == len(self.hash):
            for name in ("hash", "kind", "capital", "ends", "marks"):
                setattr(self, name, np.concatenate((getattr(self, name),) * 2))
        self.bare.append(low)
        self.hash[i] = xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass"))
        self.kind[i] = NUMBER_SLOT if NUMBER.match(low) or low in NUMBERS else UNIT_SLOT if low in UNITS or (m := QUANTITY.match(low)) and m[1] in UNITS else PLAIN_WORD
        self.capital[i] = bool(bare) and bare[0].isupper() and bare[1:] == low[1:]
        self.ends[i] = token[-1:] in ".!?:|" or not bare
        self.marks[i] = not bare
        return i


def templates(texts: list[str | None], memo: Tokens) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]]:
    """(row of each token, its template's hash, kind, its place among the bare tokens, the bare tokens, whether it starts a sentence) for runs of rows.

    A capitalised word is a name unless a sentence, a line or a table cell starts with it. Tokens of marks
    alone are left out, since layouts differ in them.
    """
    i = 0
    while i < len(texts):
        place, first, row, j = [], [], [], i
        while j < len(texts) and len(place) < PIECE:
            if len(memo) > MEMO:
                if place:
                    break
                memo.clear()
            for line in (texts[j] or "").splitlines():
                words = line.split()
                if words:
                    first.append(len(place))
                    place += [memo[w] for w in words]
            row.append(len(place))
            j += 1
        at, row = np.array(place, np.int64), np.repeat(np.arange(i, j), np.diff([0, *row]))
        if len(at):
            kind, start = memo.kind[at], np.zeros(len(at), bool)
            start[np.array(first)] = True
            start[1:] |= memo.ends[at[:-1]]
            kind[memo.capital[at] & ~start & (kind == PLAIN_WORD)] = NAME_SLOT
            keep = ~memo.marks[at]
            at, row, kind, start = at[keep], row[keep], kind[keep], start[keep]
            yield row, np.where(kind == PLAIN_WORD, memo.hash[at], kind.astype(np.uint64)), kind, at, memo.bare, start
        i = j


def window_hashes(own: np.ndarray, exact: np.ndarray, row: np.ndarray, kind: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every window of n tokens of one row, where it starts, and whether it is a template; with few plain words, or fewer tokens than FEWEST, it is the hash of the tokens themselves."""
    m = len(own) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    words = np.concatenate(([0], np.cumsum(kind == PLAIN_WORD)))
    where = np.flatnonzero(row[:m] == row[n - 1 :])
    typed = (words[where + n] - words[where] >= min(PLAIN, n - 1)) & (n >= FEWEST)
    h = np.zeros(len(where), np.uint64)
    for tokens, which in ((own, typed), (exact, ~typed)):
        at = where[which]
        g = tokens[at]
        for k in range(1, n):
            g = g * np.uint64(JOIN) + tokens[at + k]
        h[which] = mixed(g + np.uint64(n)) ^ np.uint64(0 if which is typed else JOIN)
    return h, where, typed


SCHEMA = "hash long, pos int, size int, tokens int, slots array<string>"


def window_rows(filter_bits, lengths: tuple[int, ...]):
    """Rows (id, hash, place, window, tokens of the text, slots) for all windows of the lengths that the filter lets pass; a window of one token must be a sentence.

    Without a filter the texts are items: one shorter than a window is one window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bits = Tokens(), filter_bits.value if filter_bits is not None else None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, own, kind, at, bare, start in templates(batch.column(1).to_pylist(), memo):
                count = np.bincount(row)
                begin = np.concatenate(([0], np.cumsum(count)))
                out: list[tuple] = []
                for n in lengths:
                    h, where, typed = window_hashes(own, memo.hash[at], row, kind, n)
                    if bits is not None:
                        p = (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                        hit = (bits[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                        if n == 1:
                            hit &= start & np.append(start[1:] | (row[1:] != row[:-1]), True)
                    else:
                        hit = np.full(len(h), True) if n == WINDOW else count[row[where]] == n
                    for x, w, slotted in zip(h[hit].view(np.int64).tolist(), where[hit].tolist(), typed[hit].tolist()):
                        r = int(row[w])
                        slots = [bare[at[k]] for k in range(w, w + n) if kind[k]] if slotted else []
                        out.append((ids[r], x, int(w - begin[r]), n, int(count[r]), slots))
                if out:
                    cols = list(zip(*out))
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "hash", "pos", "size", "tokens", "slots"])

    return lean(run)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, kind, coverage, windows) for each document and each benchmark item that it holds, and nothing for clean documents.

    Texts become templates: bare lower-case tokens, with typed placeholders for numbers, quantities and units,
    and names. Windows of WINDOW template tokens of documents meet those of items in a hash join. Matches of
    one alignment (place in the document less place in the item) must fill the slots consistently: a value
    of the item stands for one value of the document throughout, and different values for different ones. In an alignment that
    doesn't, only windows whose slots are all equal count. Windows with few plain words meet as exact copies. A document holds
    an item if its windows cover COVER of the item's tokens, or LONG of them. kind is `verbatim` if every slot is equal, `reparameterised`
    if some differ.

    A fixed-size filter of the items' windows, FILTER_BITS bits whatever the benchmark, lets few other windows
    leave the tasks; the join decides. Only windows of lengths that items have are looked at. Items shorter than a window match
    as a whole, items of fewer than FEWEST tokens only as they are, and one of a single token only where it is a sentence,
    a line or a cell by itself. Null and empty texts match nothing. Null ids and repeated ids: matches count by id, null ids
    are left out. Repeated items each match. Empty tables: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    few_rows(spark)
    items = kept(
        benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(window_rows(None, tuple(range(1, WINDOW + 1))), f"id long, {SCHEMA}").withColumnsRenamed({"id": "item_id", "pos": "ipos", "slots": "islots"})
    )
    sizes = tuple(sorted(r["size"] for r in items.select("size").distinct().collect()))  # at most WINDOW
    place = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    parts = items.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[np.asarray(parts.column(0))] = np.asarray(parts.column(1)).view(np.uint64)
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(window_rows(spark.sparkContext.broadcast(bits), sizes), f"id long, {SCHEMA}").select(F.col("id").alias("doc_id"), "hash", "size", "pos", "slots")
    met = found.join(items, ["hash", "size"]).where(F.size("slots") == F.size("islots"))
    met = met.select("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("shift"), "ipos", "size", F.col("tokens"), F.zip_with("islots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("pairs"))
    # an alignment has at most as many windows as the item has tokens
    line = met.groupBy("doc_id", "item_id", "shift").agg(F.collect_set(F.struct("ipos", "size", "pairs")).alias("found"), F.max("tokens").alias("tokens"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    different = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side]))) == F.size("pairs")
    agree = different("a") & different("b")
    line = line.withColumn("same", F.forall("pairs", lambda p: p["a"] == p["b"])).withColumn("agree", agree)
    sound = F.expr("filter(found, w -> agree or forall(w.pairs, p -> p.a = p.b))")
    line = line.withColumn("places", F.transform(sound, lambda w: F.struct(w["ipos"].alias("ipos"), w["size"].alias("size")))).where(F.size("places") > 0)
    whole = line.groupBy("doc_id", "item_id").agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"), F.max("tokens").alias("tokens"), F.max("same").alias("same"))
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["ipos"], p["ipos"] + p["size"] - 1))))
    share = F.size(covered) / F.col("tokens")
    return whole.select("doc_id", "item_id", F.when(F.col("same"), "verbatim").otherwise("reparameterised").alias("kind"), F.round(share, 6).alias("coverage"), F.size("places").cast("long").alias("windows")).where((share >= COVER) | (F.size(covered) >= LONG))


def op1_template_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    return contaminated(docs, benchmark)
