"""Toxicity by a weighted finite-state grammar: lexical, target, negation and report transducers, composed and run over clauses."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldqueue.llm.language import held_out
from fieldqueue.llm.lean import few_rows, lean
from fieldqueue.llm.shared import kept
from fieldqueue.llm.wordhash import JOIN, VALUES, mixed, powers, shingle_sets, spans, text_bytes

#: Labelled documents that are learned from at most, about: toxic and clean ones.
TOXIC, CLEAN = 4000, 12000
#: Hash places of the lexicon, for words and their parts, and as many for pairs; folds of the sample; evidence (likelihood ratio, 2 ln) at which a weight is shrunk to nothing; weight from which a token or pair is an insult.
PLACES, FOLDS, SHRINK, HIT = 1 << 19, 4, 10.0, 0.5
#: Bytes of the beginnings and ends of words that are entries; bytes of the parts within them.
EDGE_PARTS, INNER_PARTS = range(3, 9), (4, 6)
#: Bytes of text read at once (a longer text is read whole); rows that carry the counts; score from which a document is predicted toxic.
PIECE, SLICES, THRESHOLD = 1 << 18, 16, 0.3
#: Tokens over which a negation reaches.
REACH = 3
# Fixed values of the grammar: word lists of its symbols.
INSULTS = "idiot idiots moron morons stupid dumb clown loser losers scum trash pathetic disgusting worthless fool jerk coward liar imbecile".split()
THREATS = "kill hurt destroy beat punch stab shoot burn strangle crush smash murder".split()
TARGETS = "you your you're yourself he him she her they them u du dich dir ihr euch tu toi te vous tú ti usted ustedes él ella".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't didn't nobody without nicht kein keine nie ne pas jamais nunca".split()
REPORTS = "said says say wrote writes quoted quote called calls claimed claims reported told asked sagte schrieb disait écrit dijo escribió".split()
#: Marks that are no part of a word at its edges, and those that end a clause.
EDGES, ENDS = ".,;:!?\"'()[]{}<>|*#&%$-`~^_=+/\\", ".,;:!?|"
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
EVENTS = 16
ALIKE = str.maketrans({**dict.fromkeys("«»“”„", '"'), **dict.fromkeys("–—", "-"), "…": "."})
#: A listed insult weighs as much at least; any threat does.
LISTED = 2.0


def marks(of: str) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(of.encode(), np.uint8))


IS_EDGE, IS_END = marks(EDGES), marks(ENDS)


def target_machine(state: int, symbol: int) -> int:
    """1 once the clause has named somebody."""
    return 1 if symbol == TARGET else state


def negation_machine(state: int, symbol: int) -> int:
    """Tokens that the last negation still reaches."""
    return REACH if symbol == NEGATION else max(0, state - 1)


def report_machine(state: int, symbol: int) -> int:
    """1 once the clause reports what somebody has said."""
    return 1 if symbol == REPORT else state


def composed() -> tuple[np.ndarray, np.ndarray]:
    """The product of the three machines as tables by (state, symbol): next state, and event that is put out or -1.

    Symbols 6 and 7 are an insult and a threat that a target follows, as the right-to-left machine marks them.
    An event is a bit each for threat, aimed, negated and reported.
    """
    states = list(product((0, 1), range(REACH + 1), (0, 1)))
    number = {s: i for i, s in enumerate(states)}
    step, event = np.zeros((len(states), 8), np.int16), np.full((len(states), 8), -1, np.int16)
    for s in states:
        for symbol in range(8):
            plain = symbol if symbol < 6 else symbol - 5
            step[number[s], symbol] = number[target_machine(s[0], plain), negation_machine(s[1], plain), report_machine(s[2], plain)]
            if plain in (INSULT, THREAT):
                event[number[s], symbol] = (plain == THREAT) * 8 + (s[0] or symbol > 5) * 4 + (s[1] > 0) * 2 + s[2]
    return step, event


STEP, EVENT = (t.tolist() for t in composed())


def clause_events(symbols: list[int]) -> list[tuple[int, int]]:
    """(place, event) of each insult and threat of a clause."""
    symbols, named = list(symbols), False
    for i in range(len(symbols) - 1, -1, -1):  # right to left: does a target follow?
        if symbols[i] == TARGET:
            named = True
        elif named and symbols[i] in (INSULT, THREAT):
            symbols[i] += 5
    state, found = 0, []
    for i, s in enumerate(symbols):
        if EVENT[state][s] >= 0:
            found.append((i, EVENT[state][s]))
        state = STEP[state][s]
    return found


class Reading:
    """The tokens of a run of texts: hash, text and clause of each; distinct ones, and the places of their entries in the lexicon."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        starts, ends, before = spans(raw, at)
        solid = np.flatnonzero(~IS_EDGE[raw])  # white space is no edge, so that each token is cut alone
        i, j = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        bare = j > i
        s, e = starts.copy(), starts.copy()
        s[bare], e[bare] = solid[i[bare]], solid[j[bare] - 1] + 1
        up, down = powers(len(raw) + 1)
        self.total, self.down = np.zeros(len(raw) + 1, np.uint64), down
        np.cumsum(VALUES[raw] * up[: len(raw)], out=self.total[1:])
        closes = np.concatenate(([0], np.cumsum(IS_END[raw])))
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(before))
        first = np.ones(len(starts), bool)
        first[1:] = (closes[ends] > closes[e])[:-1] | (self.doc[1:] != self.doc[:-1])
        self.clause = np.cumsum(first)
        self.hash = self.part(s, e)
        self.distinct, one, self.back = np.unique(self.hash, return_index=True, return_inverse=True)
        self.s, self.e, self.bare = s[one], e[one], bare
        pair = mixed(np.concatenate((self.hash[:1], self.hash[:-1])) * np.uint64(JOIN) + self.hash)
        self.pair = np.where(bare & ~first, (pair % np.uint64(PLACES)).astype(np.int64) + PLACES, -1)
        if len(first):
            self.pair[1:][~bare[:-1]] = -1

    def part(self, s: np.ndarray, e: np.ndarray, kind: int = 0) -> np.ndarray:
        """Hashes of stretches of the bytes."""
        return mixed((self.total[e] - self.total[s]) * self.down[s] + (e - s + 1000 * kind).astype(np.uint64))

    def entries(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(distinct token, place): the word itself first, then its beginnings and ends and the parts within it."""
        size, which = self.e - self.s, np.flatnonzero(self.e > self.s)
        place = lambda h: (h % np.uint64(PLACES)).astype(np.int64)
        yield which, place(self.part(self.s[which], self.e[which]))
        for n in EDGE_PARTS:
            which = np.flatnonzero(size > n)
            yield which, place(self.part(self.s[which], self.s[which] + n, 1))
            yield which, place(self.part(self.e[which] - n, self.e[which], 2))
        for n in INNER_PARTS:
            many = np.maximum(size - n - 1, 0)
            which = np.repeat(np.arange(len(size)), many)
            s = self.s[which] + 1 + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            yield which, place(self.part(s, s + n, 3))


def readings(texts: list[str | None]) -> Iterator[tuple[int, int, Reading]]:
    """(first row, row after the last, what is read) for runs of rows of about PIECE bytes, lower-cased."""
    raw, at = text_bytes(pa.array([(t or "").lower().translate(ALIKE) for t in texts], pa.string()))
    i = 0
    while i < len(texts):
        j = min(len(texts), max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1))
        yield i, j, Reading(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def hashes_of(words: list[str]) -> np.ndarray:
    raw, at = text_bytes(pa.array(words, pa.string()))
    r = Reading(raw, at)
    return r.part(at[:-1], at[1:])


_lists = ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (INSULTS, INSULT))
LIST_HASH = np.concatenate([hashes_of(words) for words, _ in _lists])
LIST_CODE = np.concatenate([np.full(len(words), code) for words, code in _lists])[np.argsort(LIST_HASH)]
LIST_HASH = np.sort(LIST_HASH)


@lean
def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to rows (toxic, text) the least hash of a text's shingles, which near copies share."""
    for batch in batches:
        least = [int(s[0]) if len(s) else 0 for s in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(least, np.uint64).view(np.int64))], ["toxic", "text", "sketch"])


@lean
def entry_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, counts): documents that hold each place's entries, by fold and label, over a task's rows (toxic, text, fold)."""
    counts = np.zeros((2 * FOLDS, 2 * PLACES), np.uint16)
    for batch in batches:
        group = np.asarray(batch.column(2)) * 2 + np.asarray(batch.column(0))
        for i, _, r in readings(batch.column(1).to_pylist()):
            n = max(1, len(r.distinct))
            # the distinct tokens of each document, and the entries of each
            own = np.unique(r.doc[r.bare] * n + r.back[r.bare])
            doc, token = own // n, own % n
            order = np.argsort(token, kind="stable")
            doc, token = doc[order], token[order]
            held = [np.unique(r.doc[r.pair >= 0] * (2 * PLACES) + r.pair[r.pair >= 0])]
            for which, place in r.entries():
                a, b = np.searchsorted(token, which), np.searchsorted(token, which, "right")
                many = b - a
                at = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(many.sum())
                held.append(np.unique(doc[at] * (2 * PLACES) + np.repeat(place, many)))
            found = np.unique(np.concatenate(held))
            np.add.at(counts, (group[i + found // (2 * PLACES)], found % (2 * PLACES)), 1)
    size = 2 * PLACES // SLICES
    for k in range(SLICES):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([counts[:, k * size : (k + 1) * size].tobytes()], pa.binary())], ["slice", "counts"])


@lean
def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, counts) of all tasks; rows come sorted by slice. The sample's size bounds every count below 2 ** 16."""
    now, total = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "counts"])
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(c.as_buffer(), np.uint16)
            if k != now:
                if now is not None:
                    yield out()
                now, total = k, np.zeros(len(part), np.uint16)
            total = total + part
    if now is not None:
        yield out()


def weights(p: np.ndarray, n: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Signed weight of each place: log odds of toxic documents (p of `toxic` hold it, n of `clean`), shrunk by what chance allows."""
    if not toxic or not clean:
        return np.zeros(len(p), np.float32)
    p, n, share = p.astype(float), n.astype(float), toxic / (toxic + clean)
    odds = np.log((p + 0.5) / (toxic + 1)) - np.log((n + 0.5) / (clean + 1))
    both = np.maximum(p + n, 1)
    gain = 2 * (p * np.log(np.maximum(p, 1e-9) / both / share) + n * np.log(np.maximum(n, 1e-9) / both / (1 - share)))
    return np.clip(odds * np.maximum(0, 1 - SHRINK / np.maximum(gain, 1e-9)), -3, 5).astype(np.float32)


FEATURES = 2 * EVENTS + 8


def features(texts: list[str | None], lexicon: np.ndarray) -> np.ndarray:
    """For each text: counts and weights of the events by kind, heaviest clause, weight in all and by length, heaviest tokens of events and how many different ones, length, and 1. All but the last two come from the events of clauses."""
    out = np.zeros((len(texts), FEATURES))
    out[:, -1] = 1.0
    for i, j, r in readings(texts):
        rows, n = out[i:j], len(r.distinct)
        if not len(r.doc):
            continue
        heavy = np.zeros(n)
        for which, place in r.entries():
            w = lexicon[place].astype(float)
            if len(which):
                first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
                heavy[which[first]] = np.maximum(heavy[which[first]], np.maximum.reduceat(w, first))
        at = np.minimum(np.searchsorted(LIST_HASH, r.distinct), len(LIST_HASH) - 1)
        code = np.where(LIST_HASH[at] == r.distinct, LIST_CODE[at], OTHER)
        heavy = np.where((code == INSULT) | (code == THREAT), np.maximum(heavy, LISTED), heavy)
        code = np.where((heavy >= HIT) & (code != THREAT), INSULT, code)
        kind, weight = code[r.back], heavy[r.back]
        arc = np.where(r.pair >= 0, lexicon[np.maximum(r.pair, 0)], 0.0)
        weight = np.maximum(weight, arc)
        kind = np.where((arc >= HIT) & (kind != THREAT), INSULT, kind)
        rows[:, -2] = np.log1p(np.bincount(r.doc, minlength=j - i)) / 5
        hits = np.flatnonzero((kind == INSULT) | (kind == THREAT))
        if not len(hits):
            continue
        cut = np.flatnonzero(np.concatenate(([True], r.clause[1:] != r.clause[:-1], [True])))
        size, total, worst, best = np.bincount(r.doc, minlength=j - i), np.zeros(j - i), np.zeros(j - i), {}
        for c in np.unique(r.clause[hits]).tolist():
            a, b = int(cut[c - 1]), int(cut[c])
            d, whole = int(r.doc[a]), 0.0
            for place, e in clause_events(kind[a:b].tolist()):
                w = float(weight[a + place])
                rows[d, e] += 1
                rows[d, EVENTS + e] += w
                whole += w
                seen = best.setdefault(d, {})
                seen[int(r.hash[a + place])] = max(w, seen.get(int(r.hash[a + place]), 0.0))
            total[d] += whole
            worst[d] = max(worst[d], whole)
        rows[:, : 2 * EVENTS] = np.log1p(rows[:, : 2 * EVENTS])
        rows[:, -8], rows[:, -7], rows[:, -6] = worst / 5, np.log1p(total), total / np.maximum(size, 1) * 10
        for d, seen in best.items():
            top = sorted(seen.values(), reverse=True)
            rows[d, -5], rows[d, -4], rows[d, -3] = top[0], top[1] if len(top) > 1 else 0.0, np.log1p(len(top))
    return out


#: Weights that training starts from and is drawn to.
PRIOR = np.zeros(FEATURES)
PRIOR[EVENTS : 2 * EVENTS] = [0.4 + 0.4 * bool(e & 8) + 0.3 * bool(e & 4) - 0.6 * bool(e & 2) - 0.4 * bool(e & 1) for e in range(EVENTS)]
PRIOR[-8:] = 0.5, 0.5, 0.5, 0.3, 0.1, 0.1, 0.0, -2.5


def fit(x: np.ndarray, y: np.ndarray, pull: float = 0.5, rounds: int = 50) -> np.ndarray:
    """Logistic regression, drawn to PRIOR, by Newton steps that are halved until they are better."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + pull / 2 * ((w - PRIOR) ** 2).sum())

    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - pull * (w - PRIOR)
        h = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step, now = np.linalg.solve(h, g), loss(w)
        while loss(w + step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def feature_rows(lexicons):
    """(toxic, x) of rows (toxic, text, fold); each fold is read with the lexicon of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, texts = np.asarray(batch.column(2)), batch.column(1).to_pylist()
            x = np.zeros((len(texts), FEATURES))
            for k in range(FOLDS):
                which = np.flatnonzero(fold == k)
                x[which] = features([texts[i] for i in which], lexicons.value[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], ["toxic", "x"])

    return lean(run)


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Lexicon and weights from about TOXIC and CLEAN labelled documents, by hash of the id.

    The sample's ids (doc_id, toxic) are broadcast; the texts stay where they are. Of near copies of one label one is
    learned from. Documents that hold each entry are counted in Spark, by label and fold, into arrays of
    2 * PLACES hash places; their sums (4 * FOLDS bytes a place) and the features of the sample (FEATURES numbers a
    document) are collected. The regression reads each fold with the lexicon of the others, and at the end its
    constant is set back from the sample's share of toxic documents to that of all labels.
    """
    spark = docs.sparkSession
    few_rows(spark)
    none = np.zeros(2 * PLACES, np.float32)
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return none, PRIOR
    share = {1: min(1.0, TOXIC / sizes[1]), 0: min(1.0, CLEAN / sizes[0])}
    part = F.when(F.col("toxic") == 1, F.lit(share[1])).otherwise(F.lit(share[0]))
    sample = marked.where(F.pmod(F.xxhash64(F.lit("toxic"), F.col("doc_id").cast("string")), F.lit(1 << 30)) < part * (1 << 30))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("toxic", "text")
    rows = rows.mapInArrow(sketched, "toxic int, text string, sketch long").groupBy("toxic", "sketch").agg(F.min("text").alias("text"))
    rows = kept(rows.select("toxic", "text", F.pmod(F.xxhash64("sketch"), F.lit(FOLDS)).cast("int").alias("fold")))
    n = np.zeros((FOLDS, 2), int)
    for r in rows.groupBy("fold", "toxic").count().collect():
        n[r["fold"], r["toxic"]] = r["count"]
    if not n.sum(0).all():
        return none, PRIOR
    sums = rows.mapInArrow(entry_counts, "slice int, counts binary").repartition(SLICES, "slice").sortWithinPartitions("slice").mapInArrow(summed, "slice int, counts binary").toArrow()
    size = 2 * PLACES // SLICES
    counts = np.zeros((FOLDS, 2, 2 * PLACES), np.uint16)
    for k, c in zip(sums.column(0).to_pylist(), sums.column(1)):
        counts[:, :, k * size : (k + 1) * size] = np.frombuffer(c.as_buffer(), np.uint16).reshape(FOLDS, 2, size)
    clean, toxic = counts.sum(0, dtype=np.int64)
    all_clean, all_toxic = n.sum(0).tolist()
    folds = [weights(toxic - own[1], clean - own[0], all_toxic - m[1], all_clean - m[0]) for own, m in zip(counts, n)]
    shared = spark.sparkContext.broadcast(folds)
    seen = rows.mapInArrow(feature_rows(shared), "toxic int, x array<double>").toArrow()
    w = fit(np.array(seen.column("x").to_pylist()), np.asarray(seen.column("toxic"), float))
    shared.unpersist()
    w[-1] += np.log(sizes[1] / sizes[0]) - np.log(all_toxic / all_clean)
    return weights(toxic, clean, all_toxic, all_clean), w


def scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, w = model.value
        for batch in batches:
            x = features(batch.column(batch.num_columns - 1).to_pylist(), lexicon)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))], [*batch.schema.names[:-1], "score"])

    return lean(run)


def toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, score) of every document: the probability that it is labelled toxic.

    A lexical transducer maps each token to insult, threat, target, negation, report or other, and gives it a
    weight: the shrunk log odds of toxic documents of the heaviest of its entries (the word, beginnings, ends
    and parts of it) or of the pair that it ends. Transducers for targets, negations (which reach REACH tokens) and reported
    speech, composed into one table, run over each clause that holds an insult or a threat, and put out
    weighted events. Which events a document has, how heavy they are and in which clauses, and its length give the
    score; a word outside such a clause has no part in it.

    Null and empty texts have no event and the score that this gives. Rows of one id each come back. Without
    labels of both kinds the fixed lists and weights score alone. Empty table: no rows. Other columns are ignored.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scorer(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op5_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, learned from labels of documents whose crc32(doc_id) modulo 4 is not 2."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    out = toxicity(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
