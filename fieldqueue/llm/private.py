"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, and a span classifier decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldqueue.llm.shared import kept

# Patterns that give the same leftmost matches as the plain ones of the base rules, without backtracking: a
# possessive run, and a start that no match can reach back over (or that follows the match before).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Wider shapes that only the labelers can tell from chance: written-out addresses, national numbers, social security numbers, keys.
WIDE = (
    r"(?<![A-Za-z0-9+])(?:[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]{1,63}){1,5}"
    r"|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9A-Fa-f]{32,128})(?![A-Za-z0-9])"
)
KINDS = ("email", "ip", "card", "phone", "ssn", "secret")
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: A part of an address of four numbers is at most 255, however many zeros lead it.
OCTETS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?|)(?:\.|$)){4}$"
# Fixed values of the gazetteer and context labelers.
COUNTRY_CODES = r"^\+?(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
TOP_LEVELS = r"(?i)(?:\.|dot[\])]\x20?)(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info|biz|example|test)$"
CUES = {
    "email": r"(?i)mail|contact|write to|reply",
    "ip": r"(?i)\bip\b|host|server|address|from",
    "card": r"(?i)card|visa|credit|account|payment",
    "phone": r"(?i)phone|tel|call|fax|mobile|number",
    "ssn": r"(?i)ssn|social|security|tax",
    "secret": r"(?i)token|secret|password|passwd|api.?key|\bkey\b|auth",
}
AGAINST = r"(?i)version|isbn|page|figure|commit|sha\d*|md5|checksum|order no"
#: Characters of context on either side; rounds of estimation; score from which a span counts.
CONTEXT, ROUNDS, ACCEPT = 40, 50, 0.5
#: Features of a span, hash places of each, and the greatest weight of one.
FEATURES, PLACES, MOST = ("shape", "length", "word before", "word after", "edges"), 512, 1.5


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""
    d = digits(s)

    def step(total: Column, i: Column) -> Column:
        x = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        twice = x * 2
        return total + F.when(i % 2 == 1, x).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(OCTETS)
    if kind == "card":
        return F.when(F.length(digits(s)).between(16, 19), luhn(s)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(s)).between(8, 15)
    return F.lit(True)


def located(rows: DataFrame, name: str, pattern: str, hint: str) -> DataFrame:
    """Adds `name`: every match of the pattern as (start, end, s, before, after), places in code points.

    Texts between the matches and the matches themselves add up to the places. Sums run in blocks of about the
    root of their number, since every step of such a sum copies what it has. `hint` must match where the pattern does.
    """
    m, g, n, b, t, o = (f"_{name}_{x}" for x in "mgnbto")
    r = rows.withColumn(m, F.when(F.col("text").rlike(hint), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    r = r.withColumn(g, F.when(F.size(m) > 0, F.split("text", pattern, -1)).otherwise(F.array().cast("array<string>")))
    r = r.withColumn(n, F.zip_with(F.slice(g, F.lit(1), F.size(m)), F.col(m), lambda x, y: (F.length(x) + F.length(y)).cast("long")))
    r = r.withColumn(b, F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(m)))).cast("int"))
    none = F.array().cast("array<bigint>")
    blocks = F.when(F.size(m) > 0, F.sequence(F.lit(0), F.floor((F.size(m) - 1) / F.col(b)).cast("int"))).otherwise(F.array().cast("array<int>"))
    block = lambda i: F.slice(n, i * F.col(b) + 1, F.col(b))
    r = r.withColumn(t, F.transform(blocks, lambda i: F.aggregate(block(i), F.lit(0).cast("long"), lambda a, x: a + x)))
    start = lambda at: F.struct(at.alias("at"), none.alias("to"))
    r = r.withColumn(o, F.aggregate(t, start(F.lit(0).cast("long")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["to"], F.array(a["at"])).alias("to")))["to"])
    ends = F.flatten(F.transform(o, lambda at, i: F.aggregate(block(i), start(at), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["to"], F.array(a["at"] + x)).alias("to")))["to"]))
    r = r.withColumn(t, ends)
    span = lambda s, i: F.struct((F.get(t, i) - F.length(s)).alias("start"), F.get(t, i).alias("end"), s.alias("s"), F.substring(F.get(g, i), -CONTEXT, CONTEXT).alias("before"), F.substring(F.get(g, i + 1), 1, CONTEXT).alias("after"))
    return r.withColumn(name, F.transform(m, span)).drop(m, g, n, b, t, o)


def votes(kind: Column, x: Column, sound: Column) -> Column:
    """What the labelers say of a span: 1 for, 0 against, null abstains. sound: whether it passes its kind's base rule; null for wider shapes."""
    s, n = x["s"], F.length(digits(x["s"]))
    per = lambda f, rest: F.coalesce(*[F.when(kind == k, f(k)) for k in KINDS], F.lit(rest))
    shape = {
        "email": s.rlike(r"^[A-Za-z0-9]"),
        "ip": s.rlike(r"^[1-9]"),
        "card": s.rlike(r"^(?:[0-9]{16,19}|(?:[0-9]{4}[\x20-]){3}[0-9]{4})$"),
        "phone": n.between(10, 13),
        "ssn": ~s.rlike(r"^(?:000|666|9)|-00-|-0000$"),
        "secret": F.length(s).isin(32, 40, 48, 56, 64, 96, 128),
    }
    listed = {
        "email": s.rlike(TOP_LEVELS),
        "ip": ~s.rlike(r"^(?:0|127|255)\."),
        "card": s.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"),
        "phone": s.rlike(COUNTRY_CODES) | s.rlike(r"^\(?[2-9]"),
        "ssn": F.lit(None).cast("boolean"),
        "secret": s.rlike(r"[0-9]") & s.rlike(r"[A-Fa-f]"),
    }
    cue = per(lambda k: F.when(x["before"].rlike(CUES[k]), 1).when(x["before"].rlike(AGAINST), 0), None)
    edge = (~x["before"].rlike(r"[A-Za-z0-9_./-]$") & ~x["after"].rlike(r"^(?:[A-Za-z0-9_/]|-[A-Za-z0-9])")).cast("int")
    return F.struct(per(lambda k: shape[k].cast("int"), None).alias("regex"), per(lambda k: listed[k].cast("int"), None).alias("gazetteer"), cue.cast("int").alias("context"), edge.alias("edge"), sound.cast("int").alias("anchor"))


LABELERS = ("regex", "gazetteer", "context", "edge")


def features(kind: Column, x: Column) -> Column:
    """The hash places of a span's features, one of PLACES each: what its characters are, how many, the words on either side and the characters that touch it."""
    word = lambda s, pattern: F.regexp_extract(F.lower(s), pattern, 1)
    seen = (
        F.substring(F.translate(F.regexp_replace(F.regexp_replace(x["s"], "[A-Za-z]", "a"), "[0-9]", "9"), "\n\r\t", "   "), 1, 12),
        F.floor(F.length(x["s"]) / 4).cast("string"),
        word(x["before"], "([a-z]+)[^a-z]*$"),
        word(x["after"], "^[^a-z]*([a-z]+)"),
        F.concat(F.substring(x["before"], -1, 1), F.lit("_"), F.substring(x["after"], 1, 1)),
    )
    return F.array(*[(F.pmod(F.xxhash64(kind, F.lit(name), v), F.lit(PLACES)) + i * PLACES).cast("int") for i, (name, v) in enumerate(zip(FEATURES, seen))])


def pattern(kind: Column, vote: Column) -> Column:
    """A span's kind, votes and anchor as text, the key of what is estimated."""
    return F.concat_ws(",", kind, *[F.coalesce(vote[v].cast("string"), F.lit("-")) for v in (*LABELERS, "anchor")])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans of each kind, and all candidate spans with the labelers' votes and their features."""
    r = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for kind, hint in (("email", "@"), ("ip", r"[0-9]\.[0-9]"), ("card", "[0-9][0-9\x20-]"), ("phone", r"\+[0-9]")):
        r = located(r, kind, BASE[kind], hint)
    r = located(r, "wide", rf"{EMAIL}|{IP}|{PHONE}|{WIDE}", r"[0-9A-Fa-f]{32}|[0-9]{2}-?[0-9]{4}|[0-9][\x20.)-]{1,2}[0-9]{3}[\x20.-][0-9]{4}|[\[(]at[\])]")
    kind_of = lambda s: F.when(s.rlike(r"[\[(]at[\])]"), F.lit("email")).when(s.rlike(r"^[0-9]{3}-[0-9]{2}-"), F.lit("ssn")).when(s.rlike(r"^[0-9A-Fa-f]{32}"), F.lit("secret")).otherwise(F.lit("phone"))
    span = lambda kind, x, sound: F.struct(kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), votes(kind, x, sound).alias("vote"), features(kind, x).alias("at"))
    # short runs of digits are no candidates for anything
    def judged(kind: str) -> Column:
        least = 12 if kind == "card" else 1
        return F.transform(F.filter(kind, lambda x: F.length(x["s"]) >= least), lambda x: span(F.lit(kind), x, valid(kind, x["s"])))

    def sound(kind: str) -> Column:
        return F.transform(F.filter(kind, lambda x: valid(kind, x["s"])), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(kind)

    more = F.transform(F.filter("wide", lambda x: ~x["s"].rlike(rf"^(?:{EMAIL}|{IP}|{PHONE})$")), lambda x: span(kind_of(x["s"]), x, F.lit(None).cast("boolean")))
    return r.select("doc_id", *[sound(k) for k in BASE], F.concat(*[judged(k) for k in BASE], more).alias("found"))


def log_odds(rate: dict, prior: dict, kind: str, vote: tuple) -> float:
    """Of a span that is private, by its votes."""
    odds = math.log(prior[kind] / (1 - prior[kind]))
    for j, v in enumerate(vote):
        if v is not None:
            p, q = rate[kind, j, 1], rate[kind, j, 0]
            odds += math.log(p / q) if v else math.log((1 - p) / (1 - q))
    return odds


def estimate(patterns: list[tuple[str, tuple[int | None, ...], int | None, int]]) -> dict:
    """Labelers' rates P(for | private) and P(for | not) of each kind by expectation-maximisation over (kind, votes, anchor, times).

    Spans that base rules accept or refuse are anchors, whose label is held; the others' posteriors are estimated.
    How many spans of a kind without anchors are private can't be told from votes, and stays at a half.
    """
    anchored = {k for k, _, anchor, _ in patterns if anchor is not None}
    kinds = sorted({k for k, *_ in patterns})
    rate = {(k, j, y): 0.7 if y else 0.4 for k in kinds for j in range(len(LABELERS)) for y in (0, 1)}
    prior = dict.fromkeys(kinds, 0.5)
    post: list[float] = []
    for _ in range(ROUNDS):
        post = [float(anchor) if anchor is not None else 1 / (1 + math.exp(-log_odds(rate, prior, k, vote))) for k, vote, anchor, _ in patterns]
        for kind in kinds:
            own = [(vote, p, n) for (k, vote, _, n), p in zip(patterns, post) if k == kind]
            if kind in anchored:
                prior[kind] = (sum(p * n for _, p, n in own) + 1) / (sum(n for *_, n in own) + 2)
            for j in range(len(LABELERS)):
                for y in (0, 1):
                    part = [(vote[j], (p if y else 1 - p) * n) for vote, p, n in own if vote[j] is not None]
                    rate[kind, j, y] = (sum(w for v, w in part if v) + (1.4 if y else 0.8)) / (sum(w for _, w in part) + 2)
    return {"rate": rate, "prior": prior, "posterior": post}


def feature_weights(rows: list[tuple[int, float, float]]) -> list[float]:
    """Weight of each place: how much likelier private spans are to have it, by the posteriors (place, sum, spans), within MOST."""
    out = [0.0] * (len(FEATURES) * PLACES)
    for f in range(len(FEATURES)):
        own = [(at, yes, n) for at, yes, n in rows if at // PLACES == f]
        for at, yes, n in own:
            p, q = (yes + 1) / (sum(y for _, y, _ in own) + 2), (n - yes + 1) / (sum(m - y for _, y, m in own) + 2)
            # a place of few spans says little
            out[at] = max(-MOST, min(MOST, math.log(p / q))) * n / (n + 20)
    return out


def private_spans(docs: DataFrame) -> DataFrame:
    """For every document its base spans by kind (arrays email, ip, card, phone) and the spans that the classifier adds (array `added` of kind, start, end, score).

    Candidates are the matches of the base patterns and of wider shapes. Four labelers (regex, gazetteer,
    context, edges) vote on each; vote patterns are counted over all documents, and only these counts, at most
    a few thousand rows whatever the data, reach the driver, where expectation-maximisation estimates the
    labelers' reliabilities for each kind. The posteriors then train a span classifier on features that no labeler sees
    (shape, length, words and characters beside the span, by hash place): sums over all spans give each place a
    weight, which adds to the votes' log odds. Its score decides on spans that no base rule accepts or refuses.

    Null and empty texts have no spans. Rows of one id each come back. Without any candidate nothing is added.
    Empty table: no rows. Other columns are ignored.
    """
    rows = kept(candidates(docs))
    spans = rows.select(F.explode("found").alias("c"))
    key = pattern(F.col("c.kind"), F.col("c.vote"))
    seen = spans.groupBy("c.kind", *[F.col(f"c.vote.{v}").alias(v) for v in (*LABELERS, "anchor")]).agg(F.first(key).alias("key"), F.count("*").alias("count")).collect()
    seen = sorted(seen, key=lambda r: r["key"])
    patterns = [(r["kind"], tuple(r[v] for v in LABELERS), r["anchor"], r["count"]) for r in seen]
    found = estimate(patterns)
    odds = {r["key"]: log_odds(found["rate"], found["prior"], k, vote) for r, (k, vote, *_) in zip(seen, patterns)}
    post = docs.sparkSession.createDataFrame([(r["key"], p) for r, p in zip(seen, found["posterior"])], "key string, p double")
    # one row a pattern, as counted above
    places = spans.select(key.alias("key"), F.col("c.at").alias("at")).join(F.broadcast(post), "key").select("p", F.explode("at").alias("at")).groupBy("at").agg(F.sum("p").alias("p"), F.count("*").alias("n"))
    weights = feature_weights([tuple(r) for r in places.collect()])
    listed = lambda values: F.transform(F.split(F.lit(",".join(map(repr, values))), ","), lambda x: x.cast("double"))
    own = F.create_map(*[F.lit(v) for k in sorted(odds) if k.endswith("-") for v in (k, odds[k])]) if any(k.endswith("-") for k in odds) else F.expr("cast(map() as map<string, double>)")
    score = lambda c: 1 / (1 + F.exp(-(own[pattern(c["kind"], c["vote"])] + F.aggregate(c["at"], F.lit(0.0), lambda a, i: a + F.element_at(listed(weights), i + 1)))))
    open_ = F.filter("found", lambda c: c["vote"]["anchor"].isNull())
    added = F.filter(F.transform(open_, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), score(c).alias("score"))), lambda c: c["score"] >= ACCEPT)
    return rows.select("doc_id", *BASE, added.alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, kinds as listed, then by start."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_private_data(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans and all spans of every document."""
    r = private_spans(docs)
    plain = lambda kind, spans: F.transform(spans, lambda s: F.struct((s["kind"] if kind is None else kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    r = r.withColumn("base", F.concat(*[plain(F.lit(k), k) for k in BASE]))
    r = r.withColumn("every", F.concat("base", plain(None, "added")))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return r.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("every")).alias("spans"))
