"""Importance resampling, ranked search and host reputation against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from fieldqueue.llm import bytewords, hosts, importance, lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(text):
    return [lower(w) for w in WORD.findall(text or "")]


def made(n, seed, size=(0, 60), vocabulary=300):
    r = random.Random(seed)
    names = [f"w{int(vocabulary * r.random() ** 2)}" for _ in range(vocabulary)] + ["Ünï", "ÉTÉ", "漢字", "X9"]
    return [(i, " ".join(r.choice(names) + r.choice(["", ",", "!", "\n"]) for _ in range(r.randint(*size)))) for i in range(n)]


def features(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def resampled(docs, items, percent, longest, least, seed, buckets=10_000):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(place(f) for x in texts for f in features(x, longest)) for texts in ([x for _, x in docs], items))
    big, small = s.total() + buckets, t.total() + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * big / ((s[b] + 1) * small)))
    out = []
    for k, x in docs:
        f = features(x, longest)
        weight = sum(gain(place(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= least])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = percent * len(order) // 100
    return out, [(r[3], r[0]) for r in order[:drawn]]


@pytest.mark.parametrize("longest,percent", [(1, 10), (2, 35), (3, 100)])
def test_resampling_is_the_plain_one(spark, monkeypatch, longest, percent):
    monkeypatch.setattr(importance, "ROWS", 7)
    monkeypatch.setattr(importance, "SAMPLES", 64)
    docs = [*made(400, 1), (400, None), (401, ""), (402, "--- !"), (None, "w1 w2 w3 " * 9), (None, "w1 w2 w3 " * 9), *[(7, "w4 w5 w6 " * 8)] * 30]
    items = [x for _, x in made(20, 2)] + [None]
    d = spark.createDataFrame([(k, x, 1, 2, 3) for k, x in docs], "doc_id long, text string, weight int, _row int, score int").repartition(5)
    got = importance.resample(d, spark.createDataFrame([(x,) for x in items], "text string"), percent, longest, 12).collect()
    want, drawn = resampled(docs, items, percent, longest, 12, 2024)
    assert Counter(r[:4] for r in got) == Counter(tuple(r[:4]) for r in want)
    ranked = sorted((r["rank"], r["score"], r["doc_id"]) for r in got if r["rank"] is not None)
    assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [r[1:] for r in ranked] == drawn


def test_resampling_of_nothing(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert importance.op11_importance_resampling(none, none).collect() == []
    got = importance.op11_importance_resampling(some, none.select("text")).collect()
    assert [(r["doc_id"], r["n_features"], r["rank"]) for r in got] == [(1, 30, None)]
    assert [c for c, _ in importance.op11_importance_resampling(some, none).dtypes] == ["doc_id", "n_features", "weight", "score", "rank"]


@pytest.mark.parametrize("piece", [1, 5, 17, 1 << 20])
def test_grams_of_pieces(piece):
    text = "A b-c dé 9 x" * 7
    found = Counter(f.decode() for part in bytewords.grams(text.encode(), 3, piece) for f in part)
    assert found == Counter(features(text, 3))


def searched(docs, items, k):
    tf = [Counter(words(x)) for _, x in docs]
    size = [c.total() for c in tf]
    n, length = sum(map(bool, size)), sum(size)
    df = Counter(t for c in tf for t in c)
    out = []
    for item, x in items:
        q = Counter(words(x))
        scored = []
        for (doc, _), c, m in zip(docs, tf, size):
            if m:
                b = 25 + 75 * m * n // length
                v = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * b)) for t, r in q.items() if t in c)
                if v > 0:
                    scored.append((-v, doc is None, doc))
        out += [(item, i + 1, d, -v) for i, (v, _, d) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k])]
    return out


@pytest.mark.parametrize("block,pairs", [(12, 1 << 19), (4, 200)])
def test_search_is_the_plain_one(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    docs = [*made(500, 3), (500, None), (501, ""), (None, "w1 w2 w3 w4 w5"), (None, "w1 w2"), (3, "w9 w9 w9 zebra"), (3, "w9 w9 w9 zebra"), *[(600 + i, "w7 w8 twins here") for i in range(40)], (999, "w11 w12 " * 3000)]
    items = [*made(30, 4, (1, 25)), (50, None), (51, ""), (52, "zebra"), (53, "nowhere at all"), (54, "TWINS twins here w7"), (None, "w1 w2 w5")]
    d = spark.createDataFrame([(k, x, 1) for k, x in docs], "doc_id long, text string, n int").repartition(3)
    i = spark.createDataFrame([(k, x, 1) for k, x in items], "item_id long, text string, rank int")
    got = [tuple(r) for r in lexical.ranked_search(d, i, 10).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == sorted(searched(docs, items, 10), key=str)


def test_search_in_and_for_nothing(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")
    items = some.withColumnRenamed("doc_id", "item_id")
    assert lexical.op12_lexical_search(none, items).collect() == []
    assert lexical.op12_lexical_search(some, items.limit(0)).collect() == []
    # both documents hold the term, whose weight is floor(1000 ln(6/5))
    assert {(r["item_id"], r["doc_id"]) for r in lexical.op12_lexical_search(some, items).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}


URLS = [
    ("http://Example.com/en/1", "example.com", "/en/1", "example.com/en/", "block"),
    ("https://www.EXAMPLE.com/en/1?q=/de/", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("x://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://blog.example.com/en", "blog.example.com", "/en", "com/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://a.net/fr/#x", "a.net", "/fr/", "net/fr/", "block"),
    ("http://net/es/1", "net", "/es/1", "net/es/", "block"),
    ("http://com", "com", "", None, None),
    ("http://b.com?x=/en/", "b.com", "", None, None),
    ("a://b://c.com/", "b:", "//c.com/", None, None),
    ("no scheme/en/", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
    ("http://ünï.org/ä b\n/c", "ünï.org", "/ä b\n/c", None, None),
]


def test_rules_of_urls(spark):
    rows = [(i, u, 1, "x") for i, (u, *_) in enumerate(URLS)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, n int, host string")
    got = hosts.judge(pages, spark.createDataFrame([], "url string, n long, good long")).collect()
    assert len(got) == len(rows)
    for r in got:
        _, host, path, rule, verdict = URLS[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("allow" if r["bound"] >= hosts.LEAST else "block"))
        assert r["n_outcomes"] == 0 and r["reputation"] == 0.5


def owned(host):
    name = re.sub(r":[0-9]*\Z", "", re.sub(r"(?s)^.*@", "", host)).rstrip(".")
    label = name.split(".")
    if len(label) < 2 or re.match(r"[0-9.]+\Z|\[", name):
        return name, name
    n = 2 if ".".join(label[-2:]) in hosts.SUFFIXES else 1
    return ".".join(label[-n - 1 :]), ".".join(label[-n:])


def spread(groups):
    """groups: (n, good, parent)."""
    groups = [g for g in groups if g[0]]
    of = defaultdict(lambda: [0, 0, 0, 0.0, 0])
    for n, good, parent in groups:
        of[parent] = [x + y for x, y in zip(of[parent], (n, good, n * n, good * good / n, 1))]
    n, k, p = sum(g[0] for g in groups), len(groups), len(of)
    if k <= p or n <= k:
        return hosts.MOST
    b = sum(gg - g * g / m for m, g, _, gg, _ in of.values()) / (k - p)
    w = sum(g - gg for _, g, _, gg, _ in of.values()) / (n - k)
    e = sum(m - nn / m for m, _, nn, _, _ in of.values()) / (k - p)
    return hosts.MOST if b <= w else min(hosts.MOST, max(hosts.FEWEST, (b + (e - 1) * w) / (b - w) - 1))


def plain_reputation(counts):
    own = {h: owned(h) for h in counts}
    dom, suf = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for h, (n, g) in counts.items():
        for t, key in ((dom, own[h]), (suf, own[h][1])):
            t[key][0] += n
            t[key][1] += g
    n, g = (sum(c[i] for c in counts.values()) for i in (0, 1))
    mean = (g + 1) / (n + 2) if n else 0.5
    ks, kd, kh = spread([(*v, 0) for v in suf.values()]), spread([(*v, k[1]) for k, v in dom.items()]), spread([(*v, own[h]) for h, v in counts.items()])
    out = {}
    for h, (n, g) in counts.items():
        s = suf[own[h][1]]
        d = dom[own[h]]
        m = (g + kh * (d[1] + kd * (s[1] + ks * mean) / (s[0] + ks)) / (d[0] + kd)) / (n + kh)
        out[h] = m, m - hosts.BELOW * math.sqrt(m * (1 - m) / (n + kh + 1))
    return out


@pytest.mark.parametrize("few", [False, True])
def test_reputation_is_the_plain_one(spark, monkeypatch, few):
    if few:
        monkeypatch.setattr(hosts, "HOSTS", 3)
    r = random.Random(5)
    names = [f"{a}.{b}.{c}" for a in ("www", "m", "x") for b in ("one", "two", "three") for c in ("org", "co.uk", "info")] + ["10.0.0.1", "[::1]", "localhost", "me@one.org:80", "two.org."]
    good = {h: r.random() ** 0.3 for h in names}
    labelled = [(f"http://{h}/{i}", 2, 2 if r.random() < good[h] else 0) for i, h in enumerate(names * 12) if r.random() < 0.7] + [("http://one.org/", None, 1), ("http://one.org/", 1, None), (None, 1, 1)]
    counts = {h: (0, 0) for h in [*names, "unseen.two.org", ""]}
    for u, n, g in labelled:
        if n is not None and g is not None:
            h = u.split("/")[2] if u else ""
            counts[h] = counts[h][0] + n, counts[h][1] + g
    pages = spark.createDataFrame([(i, h and f"http://{h}/de/") for i, h in enumerate(counts)], "page_id long, url string").repartition(3)
    got = {x["host"]: x for x in hosts.judge(pages, spark.createDataFrame(labelled, "url string, n long, good long")).collect()}
    want = plain_reputation(counts)
    assert set(got) == set(want)
    for h, (m, bound) in want.items():
        assert (got[h]["reputation"], got[h]["bound"]) == pytest.approx((m, bound), abs=2e-6)
        assert got[h]["n_outcomes"] == counts[h][0]
        assert got[h]["verdict"] == ("allow" if got[h]["bound"] >= hosts.LEAST else "block")
    assert len({x["verdict"] for x in got.values()}) == 2


def test_outcomes_of_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/en/5"), (2, "http://a.org/en/5"), (3, "http://a.org/en/6.html"), (4, "http://a.org/en/7"), (5, "http://a.org/x"), (6, None)], "page_id long, url string")
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, 1), (7, None), (None, 1)], "doc_id long, quality int")
    assert sorted(map(tuple, hosts.page_outcomes(pages, labels).collect())) == [("http://a.org/en/5", 2, 2), ("http://a.org/en/6.html", 1, 0)]
    assert hosts.op13_host_reputation(pages.limit(0), labels).collect() == []
    assert hosts.op13_host_reputation(pages, labels.limit(0)).count() == 6
