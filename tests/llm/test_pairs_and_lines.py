import random

import numpy as np
import pytest

from fieldqueue.llm import decontaminate, jaccard, lines, wordhash
from fieldqueue.llm.components import components
from tests.llm import plain

DOC = "doc_id long, text string, n long, text_ string"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 7, "x") for k, t in rows], "doc_id long, text string, n_shingles long, component_id string")


def family(seed, base, size, edits):
    r = random.Random(seed)
    w = [f"w{r.randrange(300)}" for _ in range(60)]
    out = []
    for i in range(size):
        v = list(w)
        for _ in range(edits):
            v[r.randrange(len(v))] = f"e{r.randrange(10**6)}"
        out.append((base + i, " ".join(v)))
    return out


ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One  TWO"), (6, "one two three four five"), (7, "one two three four five six"), (8, "é É"), (9, "É é"), *family(1, 100, 40, 1), *family(2, 200, 40, 2), *family(3, 300, 30, 4), *[(400 + i, "same text in every row of this group here") for i in range(50)]]


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_jaccard_equals_brute_force(spark):
    assert result(jaccard.jaccard_join(frame(spark, ROWS))) == plain.jaccard_components(ROWS)


def test_jaccard_in_strips_of_few_documents(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "STRIP", 7)
    assert result(jaccard.jaccard_join(frame(spark, ROWS))) == plain.jaccard_components(ROWS)


def test_jaccard_of_one_large_cluster_in_many_strips_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 500)
    monkeypatch.setattr(jaccard, "FINE", 20)
    rows = [(10_000 - k, t) for k, t in family(5, 0, 40, 1)] + [(5000 + i, " ".join([f"w{j}" for j in range(57)] + [f"e{i}"] * (i % 3) + ["x y z"])) for i in range(260)]
    got = result(jaccard.jaccard_join(frame(spark, rows).repartition(5)))
    assert got == plain.jaccard_components(rows) and len({c for k, (_, c) in got.items() if k < 5260}) == 1


def test_jaccard_of_repeated_ids_loses_no_link(spark):
    w = [f"w{i}" for i in range(40)]
    a, b, c = " ".join(w), " ".join(w[3:] + ["x1", "x2", "x3"]), " ".join(w[6:] + ["x1", "x2", "x3", "y1", "y2", "y3"])
    assert result(jaccard.jaccard_join(frame(spark, [(5, a), (6, b), (7, c)]))) == {5: (36, 5), 6: (36, 5), 7: (36, 5)}
    for rows in ([(5, a), (5, b), (7, c)], [(5, b), (5, a), (7, c)]):
        assert sorted(map(tuple, jaccard.jaccard_join(frame(spark, rows)).collect())) == [(5, 36, 5), (5, 36, 5), (7, 36, 5)]
    # rows of one id are separate: what is near one of them isn't near the other
    far = " ".join(f"z{i}" for i in range(40))
    got = sorted(map(tuple, jaccard.jaccard_join(frame(spark, [(5, a), (5, far), (4, b), (9, far + " end")])).collect()))
    assert got == [(4, 36, 4), (5, 36, 4), (5, 36, 5), (9, 37, 5)]


def test_jaccard_of_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    assert result(jaccard.jaccard_join(frame(spark, [(1, long), (2, long + " end"), (3, "a b")]))) == {1: (199_996, 1), 2: (199_997, 1), 3: (1, 3)}


def test_jaccard_with_all_shingles_frequent(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    assert result(jaccard.jaccard_join(frame(spark, ROWS))) == plain.jaccard_components(ROWS)


def test_jaccard_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "z y x")]
    got = sorted(map(tuple, jaccard.jaccard_join(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 2, None), (1, 2, None), (None, 2, None), (2, 1, 2)], key=str)
    assert jaccard.jaccard_join(frame(spark, rows).limit(0)).count() == 0


def test_jaccard_on_the_given_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert result(jaccard.jaccard_join(d)) == plain.jaccard_components([tuple(r) for r in d.collect()])


def test_word_hashes_split_at_ascii_white_space_only():
    import pyarrow as pa

    sets = list(wordhash.shingle_sets(pa.array(["A B c", "a b C", "a b c", None, "x" * 3_000_000 + " y"])))
    assert (sets[0] == sets[1]).all() and (sets[0] != sets[2]).all() and len(sets[3]) == 0 and len(sets[4]) == 1


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(500, 400), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 41)} | {100 + i: 100 for i in range(60)} | {400: 400, 500: 400}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


LINES = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb\nc"), (4, "a\nb"), (5, None), (6, ""), (7, "q\nq\nq\nq\nq"), (8, "\n\n\n\n"), (9, " b \n\tc\nd\r"), (10, "b\nc\nd\ne\nf\n" + "long " * 5000)]


def test_line_dedup(spark):
    d = spark.createDataFrame([(k, t, 3) for k, t in LINES], "doc_id long, text string, n_lines int")
    got = lines.line_dedup(d.select("doc_id", "text")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == plain.line_dedup(LINES)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["n_removed"] == 3 and by[7]["text"] == "q" and by[5]["n_lines"] == 0 and by[2]["text"] == "x\ny"


def test_line_dedup_repeated_rows_and_empty_table(spark):
    d = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in lines.line_dedup(d).collect()), key=str)
    assert got == sorted([(1, ""), (1, ""), (None, "a\nb\nc")], key=str)
    assert lines.line_dedup(d.limit(0)).count() == 0


ITEMS = [
    (1, "If Anna Smith has 12 apples and buys 7 more apples for 3 dollars each how many dollars does Anna spend in total on fruit"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today"),
    (3, "one two"),
    (4, None),
    (5, "alpha beta gamma delta epsilon"),
]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Question: If Peter Jones has 31 apples and buys 9 more apples for 5 dollars each how many dollars does Peter spend in total on fruit", (1, "reparameterised")),
        ("Question: If Peter Jones has 31 apples and buys 9 more apples for 5 dollars each how many dollars does Mary spend in total on fruit", None),
        ("So. The quick brown fox jumps over the lazy dog near the old river bank today and on", (2, "verbatim")),
        ("the | QUICK, brown fox - jumps over the (lazy) dog near the old river bank!", (2, "verbatim")),
        ("a text that holds nothing of them but one two", (3, "verbatim")),
        ("x alpha beta gamma delta epsilon y", (5, "verbatim")),
        (None, None),
        ("", None),
        ("word " * 300_000, None),
    ],
)
def test_decontamination(spark, text, want):
    docs = spark.createDataFrame([(10, text, 1), (10, text, 1), (None, ITEMS[1][1], 1)], "doc_id long, text string, hash int")
    got = [(r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.contaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()]
    assert got == ([(10, *want)] if want else [])


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_decontamination_equals_plain_search(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    want = set()
    index = {}
    texts = {r["item_id"]: plain.words(r["text"]) for r in items.collect()}
    for i, w in texts.items():
        for j in range(len(w) - 5):
            index.setdefault(tuple(w[j : j + 6]), set()).add((i, j))
    for r in docs.collect():
        w, hit = plain.words(r["text"]), {}
        for j in range(len(w) - 5):
            for i, p in index.get(tuple(w[j : j + 6]), ()):
                hit.setdefault(i, set()).update(range(p, p + 6))
        want |= {(r["doc_id"], i) for i, p in hit.items() if len(p) >= min(13, 0.5 * len(texts[i]))}
    assert got == want and len(want) > 10


def test_block_links_are_a_forest_of_exact_links():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 40, 30).astype(np.uint64)) for _ in range(60)]
    found = jaccard.block_links(list(range(60)), sets)
    root = {i: i for i in range(60)}
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert dict(found) == {k: v for k, v in root.items() if k != v}


def test_short_items_match_as_they_are(spark):
    items = spark.createDataFrame([(1, "7 + 5 = 12"), (2, "what is seven plus"), (3, "Photosynthesis"), (4, "in 1969"), (5, None), (6, "+ = !")], "item_id long, text string")
    texts = {
        1: "they wrote 7 + 5 = 12 on the wall", 2: "they wrote 7 + 5 = 13 on the wall", 3: "So what is seven plus one?", 4: "what is eight plus", 5: "Photosynthesis is a process of plants",
        6: "a process of plants. Photosynthesis. And more", 7: "it began in 1969 there", 8: "it began in 1970 there", 9: "photosynthesis", 10: "plants\nPhotosynthesis:\nlight", 11: "",
    }
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.contaminated(d, items).collect()}
    assert got == {(1, 1, "verbatim"), (3, 2, "verbatim"), (6, 3, "verbatim"), (7, 4, "verbatim"), (9, 3, "verbatim"), (10, 3, "verbatim")}


def test_different_values_stay_different(spark):
    rest = "then walks home along the narrow path beside the quiet river and tells everybody about the old tree"
    items = spark.createDataFrame([(1, f"she has 3 apples and he has 4 pears {rest}"), (2, f"there Peter gives the book to Mary and {rest}")], "item_id long, text string")
    same, other = (items.collect()[i]["text"] for i in (0, 1))
    texts = [same.replace("3", "9").replace("4", "9"), same.replace("3", "8").replace("4", "9"), other.replace("Peter", "Anna").replace("Mary", "Anna"), other.replace("Peter", "Anna").replace("Mary", "Paul")]
    tail = "so on"
    d = spark.createDataFrame([(i, t.replace(rest, tail)) for i, t in enumerate(texts)], "doc_id long, text string")
    short = spark.createDataFrame([(r["item_id"], r["text"].replace(rest, tail)) for r in items.collect()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.contaminated(d, short).collect()}
    assert {g[:2] for g in got} == {(1, 1), (3, 2)} and {g[2] for g in got} == {"reparameterised"}


def test_decontamination_of_a_very_long_text(spark):
    item = "the quick heron counts 12 stones before the slow river takes another 7 of them away for good"
    filler = " ".join(f"word{i % 977}" for i in range(60_000))
    d = spark.createDataFrame([(1, f"{filler} {item} {filler}"), (2, filler), (1, item), (1, item)], "doc_id long, text string")
    got = decontaminate.contaminated(d, spark.createDataFrame([(4, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["kind"], r["coverage"]) for r in got] == [(1, 4, "verbatim", 1.0)]


def test_near_copies_without_ids_meet_by_their_texts(spark):
    r = random.Random(9)
    base = [f"w{r.randrange(500)}" for _ in range(60)]
    rows = []
    for i in range(2000):
        w = list(base)
        w[r.randrange(60)] = f"x{i % 700}"
        rows.append((None, " ".join(w)))
    rows += [(None, rows[0][1])] * 50 + [(5, " ".join(base)), (9, "nothing like any of the others at all"), (9, "and another of the same id here now"), (9, " ".join(base[:30]))]
    got = jaccard.jaccard_join(frame(spark, rows).repartition(6)).collect()
    assert len(got) == len(rows)
    # a null id is smaller than all others, and comes back null
    assert sum(g["doc_id"] is None and g["component_id"] is None for g in got) == 2050
    assert [g["component_id"] for g in got if g["doc_id"] == 5] == [None]
    assert sorted(g["component_id"] for g in got if g["doc_id"] == 9) == [9, 9, 9]


def test_a_long_chain_of_classes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "STRIP", 256)
    n, size = 20_000, 25
    words = [f"c{i}" for i in range(n + size)]
    rows = [(i, " ".join(words[i : i + size])) for i in range(n)]  # neighbours share 20 of 22 different shingles
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert got.where("component_id = 0 and n_shingles = 21").count() == n


def test_strips_meet_only_within_the_bounds_of_size(spark):
    need = spark.createDataFrame([(1, n) for n in range(1, 1001) for _ in range(5)] + [(2, 7)] * 900 + [(3, 4)], "cluster long, n long")
    sizes, meetings = jaccard.strips(need)
    s = {(r["cluster"], r["n"]): range(r["first"], r["first"] + r["many"]) for r in sizes.collect()}
    blocks = {(r["cluster"], r["low"], r["high"]) for r in meetings.collect()}
    parts = {(r["cluster"], r["strip"], r["low"], r["high"]) for r in meetings.collect()}
    assert len(s[2, 7]) == 8 and len(s[3, 4]) == 1
    for a in range(1, 1001):
        for b in range(a, min(1000, 5 * a // 4) + 1):
            for x in s[1, a]:
                for y in s[1, b]:
                    x, y = min(x, y), max(x, y)
                    assert (1, x, y) in blocks and {(1, x, x, y), (1, y, x, y)} <= parts
    assert len({b for b in blocks if b[0] == 1}) < 0.5 * 16 * 17 / 2 and len({b for b in blocks if b[0] == 2}) == 36
