"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldqueue.llm.lean import few_rows, lean
from fieldqueue.llm.shared import kept

#: Longest n-gram; buckets of the hash; added to every count; documents a language that are learned from; languages that a text is held against at a time.
ORDER, BUCKETS, SMOOTH, PER_LANGUAGE, COLUMNS = 3, 1 << 16, 0.5, 2000, 128
#: Characters handled at once.
PIECE = 1 << 16
#: A text without a letter, or none at all.
NONE = "und"


@cache
def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])


def pieces(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bucket of every n-gram, its row from the first, whether each row has a letter) for runs of rows.

    Texts are lower-cased, and each run of other characters than letters is one space, at both ends too.
    """
    i = 0
    while i < len(texts):
        j, size, part = i, 0, []
        while j < len(texts) and (j == i or size < PIECE):
            part.append(" " + (texts[j] or "").lower() + " ")
            size += len(part[-1])
            j += 1
        code = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(j - i), [len(p) for p in part])
        letter = letter_table()[code]
        keep = letter.copy()
        keep[1:] |= letter[:-1] | (row[1:] != row[:-1])
        keep[0] = True
        code, row, letter = np.where(letter, code, np.uint32(32))[keep].astype(np.uint64), row[keep], letter[keep]
        has = np.bincount(row[letter], minlength=j - i) > 0
        h, grams, rows = np.zeros(len(code), np.uint64), [], []
        for n in range(1, ORDER + 1):
            m = len(code) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)
            ok = (row[:m] == row[n - 1 :]) & (letter[:m] | (letter[n - 1 :] if n > 1 else False))
            x = h[ok]
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            grams.append((x >> np.uint64(48)).astype(np.int64) % BUCKETS)
            rows.append(row[:m][ok])
        yield i, j, np.concatenate(grams), np.concatenate(rows), has
        i = j


@lean
def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, times) over a task's rows (lang, text), sent on whenever COLUMNS languages have come together."""
    total: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, times in total.items():
            b = np.flatnonzero(times)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b)), pa.array(b, pa.int32()), pa.array(times[b])], ["lang", "bucket", "times"])
        total.clear()

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for i, j, gram, row, _ in pieces(batch.column(1).to_pylist()):
            own = langs[i:j]
            for lang in set(own):
                which = np.array([x == lang for x in own])
                if lang not in total and len(total) >= COLUMNS:
                    yield from out()
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))[:] += np.bincount(gram[which[row]], minlength=BUCKETS)
    yield from out()


@dataclass
class Block:
    """Some of the languages, their log-probabilities as among all, and log P(n-gram | language), n-grams by row."""

    langs: list[str]
    prior: np.ndarray
    weight: np.ndarray


@dataclass
class Model:
    """Languages in code point order, how many documents each has, and the written counts of their n-grams (place of the language, bucket, times)."""

    langs: list[str]
    docs: np.ndarray
    counts: DataFrame | None = None

    def columns(self, a: int, b: int) -> Block:
        """The model of the languages from place a to b, of which alone the counts are fetched: at most BUCKETS a language."""
        found = self.counts.where(F.col("place").between(a, b - 1)).toArrow()
        counts = np.zeros((BUCKETS, len(self.langs[a:b])))
        counts[np.asarray(found.column("bucket")), np.asarray(found.column("place")) - a] = np.asarray(found.column("times"))
        prior = np.log((self.docs + 1) / (self.docs.sum() + len(self.langs)))[a:b]
        return Block(self.langs[a:b], prior, np.log((counts + SMOOTH) / (counts.sum(0) + SMOOTH * BUCKETS)).astype(np.float32))


def train(labelled: DataFrame) -> Model:
    """From rows (doc_id, text, lang): a sample, by hash of the id, of about PER_LANGUAGE whole documents of every language that occurs.

    Only the languages' names and sizes reach the driver; counts stay in a written table until a block of languages needs them.
    """
    few_rows(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null")
    sizes = sorted((r["lang"], r["count"]) for r in rows.groupBy("lang").count().collect())
    langs = [x for x, _ in sizes]
    if not langs:
        return Model([], np.zeros(0))
    # languages that are learned from whole are the rule, and those with more documents few
    part = F.lit(1.0)
    if large := [v for x, n in sizes if n > PER_LANGUAGE for v in (x, PER_LANGUAGE / n)]:
        part = F.coalesce(F.create_map(*map(F.lit, large))[F.col("lang")], part)
    sample = rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string")), F.lit(1 << 30)) < part * (1 << 30))
    found = sample.select("lang", "text").mapInArrow(gram_counts, "lang string, bucket int, times long").groupBy("lang", "bucket").agg(F.sum("times").alias("times"))
    places = labelled.sparkSession.createDataFrame(list(enumerate(langs)), "place int, lang string")
    return Model(langs, np.array([n for _, n in sizes], float), kept(found.join(places, "lang").select("place", "bucket", "times")))


#: What a text carries from one block of languages to the next: the best so far, its log-probability, and the logarithm of the sum of all.
SO_FAR = ("_lang", "_best", "_sum")


def scorer(model, text: str, kept: list[str], last: bool):
    """Holds texts against one block of languages, and against those before by SO_FAR if the rows have it; `last` turns that into lang_pred and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            lang, best, whole, letters = [], [], [], []
            for i, j, gram, row, has in pieces(batch.column(text).to_pylist()):
                total = np.empty((j - i, len(m.langs)))
                for k in range(len(m.langs)):
                    total[:, k] = np.bincount(row, m.weight[:, k][gram], minlength=j - i) + m.prior[k]
                top = total.max(1)
                lang += [m.langs[b] for b in total.argmax(1)]
                best.append(top)
                whole.append(top + np.log(np.exp(total - top[:, None]).sum(1)))
                letters.append(has)
            best, whole, letters = (np.concatenate(x) if x else np.zeros(0) for x in (best, whole, letters))
            if SO_FAR[0] in batch.schema.names:
                before = np.asarray(batch.column(SO_FAR[1]))
                lang = [a if x >= y else b for a, b, x, y in zip(batch.column(SO_FAR[0]).to_pylist(), lang, before.tolist(), best.tolist())]
                best, whole = np.maximum(before, best), np.logaddexp(np.asarray(batch.column(SO_FAR[2])), whole)
            if last:
                found = [pa.array([x if ok else NONE for x, ok in zip(lang, letters.tolist())], pa.string()), pa.array(np.where(letters, np.exp(best - whole), 0.0))]
            else:
                found = [pa.array(lang, pa.string()), pa.array(best, pa.float64()), pa.array(whole, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], [*kept, *(("lang_pred", "score") if last else SO_FAR)])

    return lean(run)


def held_out(doc_id: Column, parts: int = 4) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) with lang_pred and score, the model's probability of that language; `und` and 0 if the text is null or has no letter, or nothing was learned.

    Ties go to the first language in code point order. Texts are held against COLUMNS languages at a time, so that a
    worker's memory doesn't grow with their number. Very long texts are scored whole, a batch's characters
    in pieces of whole texts. Columns of docs that are named lang_pred or score give way. Empty table: no rows.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", *SO_FAR)]
    rows = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])])
    if not model.langs:
        return rows.select(*[F.col(f"`{c}`") for c in kept], F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"))
    types = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    for k in range(0, len(model.langs), COLUMNS):
        last = k + COLUMNS >= len(model.langs)
        own = kept if last else list(types)
        schema = ", ".join(f"`{c}` {types[c]}" for c in own) + (", lang_pred string, score double" if last else ", _lang string, _best double, _sum double")
        shared = docs.sparkSession.sparkContext.broadcast(model.columns(k, k + COLUMNS))
        rows = rows.mapInArrow(scorer(shared, text, own, last), schema)
    return rows


def op10_language_id(docs: DataFrame) -> DataFrame:
    """Predictions for every document, learned from those whose crc32(doc_id) modulo 4 is not 2."""
    d = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = train(d.where("not held_out").select("doc_id", "text", "lang"))
    return identify(d, model, keep=["doc_id", "held_out"])
