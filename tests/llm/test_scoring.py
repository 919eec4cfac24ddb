import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from fieldqueue.llm import langmodel, language, mixing, neighbours, private, tokencount, toxicity
from tests.llm import plain

SF = "/root/testdata/sf0.01"


def rest(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n == 2


def test_private_spans_equal_plain_patterns(spark):
    r = random.Random(3)
    alphabet = "aZ9.@+-_ %()0124567 1.2.3.4 @b.c é😀"
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.choice([5, 40, 300])))) for i in range(800)]
    rows += [(9001, None), (9002, ""), (9003, "a@b.c_d@e.f+1 (017) 555-7713"), (9004, "1" * 3000), (9006, "12," * 3000), (9007, "1 " * 3000), (9008, "4111111111111111 x 4111-1111-1111-1111 000.0.00.0255 256.1.1.1"), (9009, "a@" + "b." * 3000 + "c"), (9010, "+1" + "(" * 3000)]
    d = spark.createDataFrame([(k, t, 1, "e") for k, t in rows], "doc_id long, text string, n_email int, email string")
    got = {x["doc_id"]: x for x in private.op2_private_data(d).collect()}
    for k, t in rows:
        spans, digest = plain.base_spans(t)
        assert got[k]["base_sha256"] == digest
        assert {f"{a}:{b}:{c}" for a, b, c in spans} <= set(got[k]["spans"].split(",")) | {""}
        assert got[k]["n_card"] == sum(s[0] == "card" for s in spans)


def test_private_spans_of_long_texts_and_empty_table(spark):
    d = spark.createDataFrame([(1, "1" * 2_000_000), (2, "a" * 2_000_000), (3, "ab cd " * 200_000 + "x@y.zz"), (4, "12.5 " * 50_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in private.op2_private_data(d).collect()}
    assert got == {1: "", 2: "", 3: "email:1200000:1200006", 4: ""}
    assert private.op2_private_data(d.limit(0)).count() == 0


def test_classifier_adds_what_labelers_agree_on(spark):
    rows = [(i, f'mail a{i}@b.com or call +1 (212) 555-{1000 + i} token = "{i:032x}ab" end') for i in range(40)]
    rows += [(100, "version 12345678 of nothing"), (101, "write to joe (at) site (dot) org now")]
    got = {r["doc_id"]: r["spans"] for r in private.op2_private_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "email:" in got[101] and got[100] == "" and all("email:5:" in got[i] for i in range(10))


def test_added_spans_equal_a_plain_estimate(spark):
    r = random.Random(4)
    rows = []
    for i in range(300):
        n = r.randrange(10**6)
        rows.append((i, r.choice([f"write to joe{n} (at) site (dot) org now", f"password = {n:032x} end", f"commit {n:032x} of page", f"tel 212-555-{n % 10000:04d} fax", f"order no 212-555-{n % 10000:04d}.", f"ssn 12{n % 10}-45-{n % 10000:04d}", f"mail a{n}@b.com and 10.0.0.{n % 400}", f"call +1 (212) 555-{n % 10000:04d} or 4111111111111111"])))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    spans = [(x["doc_id"], c) for x in private.candidates(d).collect() for c in x["found"]]
    votes = lambda c: tuple(c["vote"][v] for v in private.LABELERS)
    # every span on its own, where the operator counts patterns
    yes = {(k, j, y): 0.7 if y else 0.4 for k in private.KINDS for j in range(4) for y in (0, 1)}
    prior = dict.fromkeys(private.KINDS, 0.5)

    def odds(c):
        terms = [yes[c["kind"], j, 1] / yes[c["kind"], j, 0] if v else (1 - yes[c["kind"], j, 1]) / (1 - yes[c["kind"], j, 0]) for j, v in enumerate(votes(c)) if v is not None]
        return math.log(prior[c["kind"]] / (1 - prior[c["kind"]])) + sum(map(math.log, terms))

    for _ in range(private.ROUNDS):
        post = [c["vote"]["anchor"] if c["vote"]["anchor"] is not None else 1 / (1 + math.exp(-odds(c))) for _, c in spans]
        for k in private.KINDS:
            own = [(votes(c), p) for (_, c), p in zip(spans, post) if c["kind"] == k]
            if any(c["kind"] == k and c["vote"]["anchor"] is not None for _, c in spans):
                prior[k] = (sum(p for _, p in own) + 1) / (len(own) + 2)
            for j in range(4):
                given = [(v[j], p) for v, p in own if v[j] is not None]
                yes[k, j, 1] = (sum(p for v, p in given if v) + 1.4) / (sum(p for _, p in given) + 2)
                yes[k, j, 0] = (sum(1 - p for v, p in given if v) + 0.8) / (sum(1 - p for _, p in given) + 2)
    total, by, n = Counter(), Counter(), Counter()
    for (_, c), p in zip(spans, post):
        for at in c["at"]:
            total[at // private.PLACES, 1] += p
            total[at // private.PLACES, 0] += 1 - p
            by[at] += p
            n[at] += 1

    def weight(at):
        f = at // private.PLACES
        w = math.log((by[at] + 1) / (total[f, 1] + 2) / ((n[at] - by[at] + 1) / (total[f, 0] + 2)))
        return max(-private.MOST, min(private.MOST, w)) * n[at] / (n[at] + 20)

    want = {(k, c["kind"], c["start"], c["end"]): 1 / (1 + math.exp(-odds(c) - sum(map(weight, c["at"])))) for k, c in spans if c["vote"]["anchor"] is None}
    got = {(x["doc_id"], a["kind"], a["start"], a["end"]): a["score"] for x in private.private_spans(d).collect() for a in x["added"]}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= private.ACCEPT}, rel=1e-6) and 20 < len(got) < len(want)


def test_language_model_base_is_exact_and_model_is_better(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in d.collect()] + [(5000, None), (5001, ""), (5002, "x" * 100_000)]
    got = {r["doc_id"]: r for r in langmodel.op4_language_model(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    count = Counter()
    token = lambda t: [*plain.words(t), None]
    for k, t in rows:
        if not rest(k, 7):
            count.update(token(t))
    n, v = sum(count.values()), len(count)
    for k, t in rows:
        g = got[k]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in token(t))
        assert (g["n_tokens"], g["n_known"], g["train_tokens"], g["held_out"]) == (len(token(t)), sum(count[w] > 0 for w in token(t)), n, rest(k, 7))
        assert math.isclose(g["base_score"], base, rel_tol=1e-9)
    held = [g for g in got.values() if g["held_out"]]
    assert sum(g["score"] for g in held) > sum(g["base_score"] for g in held)
    assert all(g["score"] < 0 for g in got.values())


def test_language_model_of_few_frequent_tokens_and_narrow_filter(spark, monkeypatch):
    rows = [(i, f"a b c{i % 5} d{i}") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r["doc_id"]: r["base_score"] for r in langmodel.op4_language_model(d).collect()}
    monkeypatch.setattr(langmodel, "FREQUENT", 2)
    assert {r["doc_id"]: r["base_score"] for r in langmodel.op4_language_model(d).collect()} == pytest.approx(whole)
    assert langmodel.op4_language_model(d.limit(0)).count() == 0


def test_filter_gives_levels_back():
    gram = np.arange(1, 4001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    times = np.random.default_rng(1).zipf(1.5, 4000).clip(1, 10**6)
    import pyarrow as pa

    own = langmodel.region(gram)
    order = np.argsort(own, kind="stable")
    batch = pa.RecordBatch.from_arrays([pa.array(np.ones(4000, np.int32)), pa.array(gram[order].view(np.int64)), pa.array(times[order]), pa.array(own[order].astype(np.int32))], ["n", "gram", "times", "region"])
    bits = np.zeros(langmodel.FILTER_BITS // 8, np.uint8)
    size = len(bits) // langmodel.REGIONS
    for out in langmodel.region_bits({1: 1, 2: 2})(iter([batch])):
        r = out.column(0)[0].as_py()
        bits[r * size : (r + 1) * size] = np.frombuffer(out.column(1)[0].as_py(), np.uint8)
    bloom = langmodel.LogFrequencyFilter(bits, {1: 1, 2: 2})
    found = bloom.levels(gram, 1)
    assert (found >= langmodel.level(times)).all() and (found == langmodel.level(times)).mean() > 0.99
    assert (bloom.levels(gram + np.uint64(1), 1) > 0).mean() < 0.01


def test_toxicity_of_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.op5_toxicity(docs, labels).collect()}
    pairs = [(r["toxic"], got[r["doc_id"]]["predicted"]) for r in labels.collect() if rest(r["doc_id"], 4)]
    caught = sum(p for t, p in pairs if t) / sum(t for t, _ in pairs)
    alarms = sum(p for t, p in pairs if not t) / sum(not t for t, _ in pairs)
    assert caught > 0.9 and alarms < 0.01 and len(got) == docs.count()


def test_grammar_regards_target_negation_and_report():
    none = np.zeros(2 * toxicity.PLACES, np.float32)
    score = lambda t: float(1 / (1 + np.exp(-toxicity.features([t], none)[0] @ toxicity.PRIOR)))
    pad = " and so on and so on and so on and so on and so on and so on and so on"
    assert score("you are an idiot" + pad) > score("there is an idiot" + pad) > score("there is not an idiot" + pad) > score("nothing at all")
    assert score("he said you are an idiot" + pad) < score("hm and you are an idiot" + pad)
    assert score("idiot that you are" + pad) > score("idiot that there is" + pad)
    assert score("you, an idiot" + pad) < score("you an idiot" + pad)
    assert score(None) == score("") == score(" .. !")


def test_clause_events_equal_a_plain_reading():
    t, r = toxicity, random.Random(8)
    for _ in range(500):
        symbols = [r.choice([t.OTHER, t.OTHER, t.INSULT, t.THREAT, t.TARGET, t.NEGATION, t.REPORT]) for _ in range(r.randrange(12))]
        want = []
        for i, s in enumerate(symbols):
            if s in (t.INSULT, t.THREAT):
                aimed, reported = t.TARGET in symbols, t.REPORT in symbols[:i]
                negated = t.NEGATION in symbols[max(0, i - t.REACH) : i]
                want.append((i, 8 * (s == t.THREAT) + 4 * aimed + 2 * negated + reported))
        assert t.clause_events(symbols) == want


def test_entries_are_counted_by_document_fold_and_label():
    import pyarrow as pa

    texts, toxic, fold = ["Blorgit, blorgit the cat.", "the blorgit cat", None, "a cat"], [1, 0, 1, 0], [0, 0, 1, 1]
    batch = pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(texts), pa.array(fold, pa.int32())], ["toxic", "text", "fold"])
    size = 2 * toxicity.PLACES // toxicity.SLICES
    counts = np.zeros((2 * toxicity.FOLDS, 2 * toxicity.PLACES), np.uint16)
    for out in toxicity.summed(toxicity.entry_counts(iter([batch]))):
        k = out.column(0)[0].as_py()
        counts[:, k * size : (k + 1) * size] = np.frombuffer(out.column(1)[0].as_py(), np.uint16).reshape(-1, size)
    place = lambda w: int(toxicity.hashes_of([w])[0] % np.uint64(toxicity.PLACES))
    assert counts[:4, place("blorgit")].tolist() == [1, 1, 0, 0] and counts[:4, place("cat")].tolist() == [1, 1, 1, 0]
    # "the blorgit", "blorgit cat"; "blorgit the", "the cat"; "a cat"
    assert counts[:4, toxicity.PLACES :].sum(1).tolist() == [2, 2, 1, 0] and not counts[4:].any()


def plain_toxicity(text, lexicon, w):
    """The score by loops over tokens and clauses."""
    from fieldqueue.llm import wordhash

    t, m = toxicity, 2**64
    raw = (text or "").lower().translate(t.ALIKE).encode()

    def mix(h):
        for f in (wordhash.MIX1, wordhash.MIX2):
            h = ((h ^ h >> 33) * f) % m
        return h ^ h >> 33

    h = lambda b, kind=0: mix((sum(int(wordhash.VALUES[c]) * pow(wordhash.STEP, i, m) for i, c in enumerate(b)) + len(b) + 1000 * kind) % m)
    tokens, clauses, closed = raw.split(), [], True
    edges, ends = t.EDGES.encode(), t.ENDS.encode()
    for k in tokens:
        core = k.strip(edges)
        tail = k[len(k.rstrip(edges)) :]
        if closed:
            clauses.append([])
        clauses[-1].append((core, bool(core)))
        closed = any(c in ends for c in tail)
    codes = [(t.INSULTS, t.INSULT), (t.REPORTS, t.REPORT), (t.NEGATIONS, t.NEGATION), (t.TARGETS, t.TARGET), (t.THREATS, t.THREAT)]
    x = np.zeros(t.FEATURES)
    x[-1], x[-2] = 1.0, np.log1p(len(tokens)) / 5 if tokens else 0.0
    total, worst, best = 0.0, 0.0, {}
    for clause in clauses:
        kinds, weight = [], []
        for i, (word, bare) in enumerate(clause):
            n = len(word)
            entries = [h(word)] * bare + [h(word[:k], 1) for k in t.EDGE_PARTS if n > k] + [h(word[-k:], 2) for k in t.EDGE_PARTS if n > k] + [h(word[j : j + k], 3) for k in t.INNER_PARTS for j in range(1, n - k)]
            heavy = max([0.0, *(float(lexicon[e % t.PLACES]) for e in entries)])
            kind = next((c for names, c in codes if word.decode() in names), t.OTHER)
            heavy = max(heavy, t.LISTED) if kind in (t.INSULT, t.THREAT) else heavy
            kind = t.INSULT if heavy >= t.HIT and kind != t.THREAT else kind
            if i and bare and clause[i - 1][1]:
                arc = float(lexicon[mix((h(clause[i - 1][0]) * wordhash.JOIN + h(word)) % m) % t.PLACES + t.PLACES])
                heavy, kind = max(heavy, arc), t.INSULT if arc >= t.HIT and kind != t.THREAT else kind
            kinds.append(kind)
            weight.append(heavy)
        whole = 0.0
        for i, kind in enumerate(kinds):
            if kind in (t.INSULT, t.THREAT):
                e = 8 * (kind == t.THREAT) + 4 * (t.TARGET in kinds[:i] + kinds[i + 1 :]) + 2 * (t.NEGATION in kinds[max(0, i - t.REACH) : i]) + (t.REPORT in kinds[:i])
                x[e] += 1
                x[t.EVENTS + e] += weight[i]
                whole += weight[i]
                best[clause[i][0]] = max(best.get(clause[i][0], 0.0), weight[i])
        total, worst = total + whole, max(worst, whole)
    x[: 2 * t.EVENTS] = np.log1p(x[: 2 * t.EVENTS])
    top = sorted(best.values(), reverse=True)
    if top:
        x[-8], x[-7], x[-6] = worst / 5, np.log1p(total), total / len(tokens) * 10
        x[-5], x[-4], x[-3] = top[0], top[1] if len(top) > 1 else 0.0, np.log1p(len(top))
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def test_toxicity_is_the_plain_score(spark):
    t, r = toxicity, random.Random(4)
    lexicon = np.random.default_rng(4).normal(-0.6, 0.6, 2 * t.PLACES).astype(np.float32)
    w = t.PRIOR + np.random.default_rng(5).normal(0, 0.3, t.FEATURES)
    vocabulary = [x[0] for x in (t.INSULTS, t.THREATS, t.NEGATIONS, t.REPORTS)] + t.TARGETS[:6] + ["cat", "house", "überall", "internationalisation", "--", "«cat»,", "you,", "kill!", "not", "sagte:", "é", "…"]
    texts = [None, "", "   ", "!!!", "idiot", "You idiot. not you"] + [" ".join(r.choice(vocabulary) + r.choice(["", "", ",", "."]) for _ in range(r.randint(1, 40))) for _ in range(40)]
    texts.append("the cat is not an idiot, he said. " * 900)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["score"] for x in t.toxicity(d, (lexicon, w)).collect()}
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(plain_toxicity(text, lexicon, w), abs=1e-6), text


def test_words_outside_clauses_of_insult_or_threat_do_not_score(spark):
    lexicon = np.full(2 * toxicity.PLACES, -2.0, np.float32)
    x = toxicity.features(["you idiot. the weather is fine", "you idiot. a dog runs away"], lexicon)
    assert (x[0, :-2] == x[1, :-2]).all()


@pytest.mark.parametrize("where", ["word", "start", "end", "inside", "pair"])
def test_toxic_vocabularies_that_no_list_holds(spark, where):
    r = random.Random(where)
    syllables = "ba ko lu mi ne ro sa ti vu we xo ya".split()
    word = lambda n=3: "".join(r.choice(syllables) for _ in range(n))
    bad = {"word": lambda: r.choice(["grolnak", "fezzip"]), "start": lambda: r.choice(["grolk", "fezz"]) + word(2), "end": lambda: word(2) + r.choice(["grolk", "fezz"]), "inside": lambda: word(1) + r.choice(["grolk", "fezz"]) + word(1), "pair": lambda: "bako lumi"}[where]
    common = ["bako", "lumi", *(word() for _ in range(40))]
    rows, labels = [], []
    for i in range(1200):
        w = [r.choice(common) if r.random() < 0.3 else word() for _ in range(60)]
        w = [x if x != "lumi" or y != "bako" else "ne" for x, y in zip(w, [""] + w)]
        toxic = i % 6 == 0
        if toxic:
            w.insert(r.randrange(60), bad())
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    got = {x["doc_id"]: x["score"] for x in toxicity.op5_toxicity(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    clean = sorted(got[k] for k, t in labels if not t and rest(k, 4))
    bound = clean[math.ceil(0.9 * len(clean))]
    hits = [got[k] > bound for k, t in labels if t and rest(k, 4)]
    assert sum(hits) / len(hits) >= 0.9


def test_toxicity_without_labels(spark):
    rows = [(1, None), (2, ""), (3, "you idiot " * 100_000), (3, "x")]
    docs = spark.createDataFrame([(*r, 7, 1) for r in rows], "doc_id long, text string, score int, toxic int")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.op5_toxicity(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.op5_toxicity(docs.limit(0), labels).count() == 0


def test_token_counts_equal_the_library(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in d.collect()] + [(5000, None), (5001, ""), (5002, "x" * 100_000), (5003, "<|endoftext|> é́ e̊ " * 4000), (5004, "word " * 60_000)]
    t = tokencount.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in tokencount.op6_token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, x in rows:
        n = len(t.encode(x or "", add_special_tokens=False))
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len((x or "").encode()), n, n > 2048)


def test_token_counts_odd_rows_and_other_tokenizers(spark):
    d = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, " ", 5, "x")], "doc_id long, text string, n_tokens int, over_limit string")
    got = sorted(map(tuple, tokencount.op6_token_counts(d).collect()), key=str)
    assert got == sorted([(1, 3, 2, False), (1, 3, 2, False), (None, 1, 0, False)], key=str)
    assert tokencount.op6_token_counts(d.limit(0)).count() == 0
    # one that counts white space too is encoded whole
    assert not tokencount.runs_alone(list) and tokencount.runs_alone(str.split)


def test_splicing_of_small_chunks():
    t = tokencount.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    encode = lambda x: t.encode(x, add_special_tokens=False)
    r = random.Random(1)
    for _ in range(150):
        x = "".join(r.choice(["ab", "the ", " ", "\n", "é́", "'s", "<|endoftext|>", "12", "!", "x" * 50, " ", "ΣΑΣ "]) for _ in range(r.randrange(200)))
        for chunk, overlap in ((300, 20), (64, 8), (16, 4)):
            assert tokencount.spliced_count(x, encode, chunk, overlap) == len(encode(x))


def test_mix_comes_near_targets(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source")
    got = mixing.pareto_mix(d).toPandas()
    assert (got.taken <= 2 * got["size"]).all() and (got.source_size * 2 + 1e-6 >= got.target).all()
    by = got.groupby("source").agg({"taken": "sum", "target": "first"})
    assert ((by.taken - by.target).abs() <= 0.01 * by.target + 1).all()
    assert abs(by.target.sum() - 1.5 * got["size"].sum()) < 1
    again = mixing.pareto_mix(d.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


def test_mix_draws_in_proportion_to_size(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 20), "a" if i % 3 else "b") for i in range(30_000)] + [(40_000, "w " * 50_000, "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    # a third of the words of either source: the one document of 50,000 words is certain
    got = mixing.pareto_mix(d, weights=(1,), share=0.34).toPandas()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 25
        assert math.isclose((g.inclusion * g["size"]).sum(), g.target.iloc[0])
        for size, own in g[g["size"] <= 20].groupby("size"):
            p = own.inclusion.iloc[0]
            assert math.isclose(p / size, g[g["size"] == 1].inclusion.iloc[0]) and abs(own.copies.mean() - p) < 5 * math.sqrt(p / len(own))
    assert got[got.doc_id == 40_000].copies.tolist() == [1]
    monkeypatch.setattr(mixing, "BUCKETS", 2)
    again = mixing.pareto_mix(d, weights=(1,), share=0.34).toPandas()
    key = ["doc_id", "copies"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


def test_mix_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (4, "w " * 100_000, "b"), (5, "p q r", "b"), (5, "p q r", "b"), (None, "u v", "b"), (6, "", "c")]
    d = spark.createDataFrame([(*r, 9, "t") for r in rows], "doc_id long, text string, source string, size int, target string")
    got = mixing.op8_pareto_mix(d).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.op8_pareto_mix(d.limit(0)).count() == 0


def recall(rows, got):
    """Share of the true five nearest that were found."""
    x = np.array(rows.embedding.tolist(), float)
    unit, ids = x / np.sqrt((x * x).sum(1))[:, None], rows.vec_id.values
    hit = total = 0
    for q, g in got.groupby("query_id"):
        s = unit @ unit[list(ids).index(q)]
        s[ids == q] = -9
        best = set(ids[np.lexsort((ids, -s))[:5]])
        hit, total = hit + len(best & set(g.vec_id)), total + 5
        assert g.sort_values("rank").score.is_monotonic_decreasing
    assert total == 5 * (ids % 50 == 0).sum()
    return hit / total


def test_nearest_recall_and_scores(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = neighbours.op9_hash_forest(d).toPandas()
    # nothing is near anything in this table, and still no query is held against all of it
    assert recall(d.toPandas(), got) >= 0.9 and got.matches.max() < 0.95 * 2000


def test_nearest_of_clustered_vectors_with_few_matches(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "FIRST", 600)
    r = np.random.default_rng(3)
    x = r.standard_normal((300, 24))[r.integers(0, 300, 6000)] + 0.25 * r.standard_normal((6000, 24))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.op9_hash_forest(d).toPandas()
    assert recall(d.toPandas(), got) >= 0.9 and got.matches.mean() < 600


def test_nearest_edge_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, [-1.0, 0.0]), (7, [1.0, 0.0, 0.0]), (8, [1e-300, 0.0]), (50, [0.0, 1e300]), (None, [1.0, 1.0])]
    rows += [(100 + i, [1.0, 1.0]) for i in range(1, 40)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = [tuple(r) for r in neighbours.op9_hash_forest(d).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got if g[0] == 0] == [(0, 1, 8), (0, 2, 101), (0, 3, 102), (0, 4, 103), (0, 5, 104)]
    assert {g[0] for g in got} == {0, 50} and all(g[2] not in (1, 2, 3, 4, 5, 7, None) for g in got)
    few = spark.createDataFrame(rows[:1] + rows[6:7], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in neighbours.op9_hash_forest(few).collect()] == [(0, 1, 6)]
    assert neighbours.op9_hash_forest(d.limit(0)).count() == 0


def test_nearest_in_many_blocks_and_from_the_root(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    r = np.random.default_rng(2)
    x = np.abs(r.standard_normal((600, 8)))
    x[0] = -1.0  # nothing shares a prefix with this one
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.op9_hash_forest(d).toPandas()
    assert (got.groupby("query_id").size() == 5).all() and got.query_id.nunique() == 12
    # with every row a match, blocks and parts give what one block gives, and all of it
    monkeypatch.setattr(neighbours, "FIRST", 10**9)
    want = neighbours.op9_hash_forest(d).toPandas()
    assert recall(d.toPandas(), want) == 1 and (want.matches == 600).all()


def test_nearest_of_a_vector_that_most_rows_hold(spark):
    r = np.random.default_rng(6)
    x = r.standard_normal((400, 6))
    rows = [(i, x[i].tolist() if i % 3 else [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(400)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = neighbours.op9_hash_forest(d).toPandas()
    same = [i for i in range(400) if i % 3 == 0]
    for q, g in got.groupby("query_id"):
        if q % 3 == 0:
            assert g.sort_values("rank").vec_id.tolist() == [i for i in same if i != q][:5] and (abs(g.score - 1) < 1e-12).all()
    assert got.query_id.nunique() == 8 and recall(d.toPandas(), got) >= 0.9


def test_languages_of_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = d.select("doc_id", "lang").collect()
    got = {r["doc_id"]: r for r in language.op10_language_id(d).collect()}
    pairs = [(r["lang"], got[r["doc_id"]]["lang_pred"]) for r in rows if r["lang"] and rest(r["doc_id"], 4)]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.98


def language_plain(learned, texts):
    """{text: (lang, score)} by counting every n-gram of the texts, with the operator's hash of an n-gram."""

    def grams(t):
        flat = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in " " + t.lower() + " ")
        return [int(g) for g in next(language.pieces([" ".join(flat.split(" "))]))[2]] if flat.strip() else []

    langs = sorted({x for x, _ in learned})
    count = {x: Counter() for x in langs}
    for x, t in learned:
        count[x].update(grams(t))
    n = Counter(x for x, _ in learned)
    out = {}
    for t in texts:
        z = {}
        for x in langs:
            total = sum(count[x].values())
            z[x] = math.log((n[x] + 1) / (len(learned) + len(langs))) + sum(math.log((count[x][g] + language.SMOOTH) / (total + language.SMOOTH * language.BUCKETS)) for g in grams(t))
        best = max(langs, key=lambda x: (z[x], [-ord(c) for c in x]))
        out[t] = (best, 1 / sum(math.exp(v - z[best]) for v in z.values())) if grams(t) else ("und", 0.0)
    return out


def test_language_equals_plain_bayes_and_learns_every_language(spark, monkeypatch):
    monkeypatch.setattr(language, "COLUMNS", 7)
    r = random.Random(6)
    words = {f"l{k:03d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyzäéñ") for _ in range(r.randrange(2, 6))) for _ in range(6)] for k in range(300)}
    rows = [(x, " ".join(r.choice(w) for _ in range(12))) for x, w in words.items() for _ in range(2)]
    texts = [" ".join(r.choice(w) for _ in range(8)) for w in list(words.values())[:40]] + ["", "12 -", "É x"]
    # ties: two languages of the same texts
    rows += [("tie-b", "zqz " * 20), ("tie-a", "zqz " * 20)]
    texts.append("zqz zqz zqz")
    model = language.train(spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string"))
    got = {g["text"]: (g["lang_pred"], g["score"]) for g in language.identify(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()}
    want = language_plain(rows, texts)
    assert len(model.langs) == 302 and got["zqz zqz zqz"][0] == "tie-a"
    assert {t: v[0] for t, v in got.items()} == {t: v[0] for t, v in want.items()}
    assert all(math.isclose(got[t][1], want[t][1], rel_tol=1e-3, abs_tol=1e-6) for t in texts)


def test_language_edge_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 ***", "en"), (4, "the cat and the dog " * 50_000, "en"), (5, "der Hund und die Katze", "de"), (6, "the dog", None), (6, "the dog", None), (7, "und der", None)]
    d = spark.createDataFrame([(*r, 2.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r["lang_pred"] for r in language.op10_language_id(d).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[6] == "en"
    assert {r["lang_pred"] for r in language.op10_language_id(d.where("lang is null")).collect()} == {"und"}
    assert language.op10_language_id(d.limit(0)).count() == 0


def test_levels_probed_together_are_those_probed_one_by_one(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    gram, times = rng.integers(0, 2**63, 3000).astype(np.uint64), np.minimum(rng.zipf(1.3, 3000), 10**6).astype(np.int64)
    own = langmodel.region(gram)
    order = np.argsort(own, kind="stable")
    whole = 64 * langmodel.REGIONS * 8
    batch = pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (np.ones(3000, np.int32), gram.view(np.int64), times, own.astype(np.int32))], ["n", "gram", "times", "region"])
    bits = np.zeros((langmodel.REGIONS, whole // 8 // langmodel.REGIONS), np.uint8)
    for out in langmodel.region_bits({1: 1}, whole)(iter([batch])):
        for r, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            bits[r] = np.frombuffer(b, np.uint8)
    bloom = langmodel.LogFrequencyFilter(bits.ravel(), {1: 1})
    asked = np.concatenate((gram, rng.integers(0, 2**63, 3000).astype(np.uint64)))
    together = bloom.levels(asked, 1)
    monkeypatch.setattr(langmodel, "FEW", 0)
    assert (bloom.levels(asked, 1) == together).all() and (together[:3000] >= langmodel.level(times)).all()
