"""Nothing is left out of a result: each test held a cut that was there before."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from fieldqueue.llm import decontaminate, langmodel
from tests.llm import plain


def language_model_plain(rows):
    """{doc_id: score} from all counts and all training documents."""
    level = lambda c: int(langmodel.level(np.array(c)))
    value = lambda c: float(langmodel.VALUES[level(c)])
    tokens = {k: [None, *plain.words(t), None] for k, t in rows}
    learned = [k for k in tokens if zlib.crc32(str(k).encode()) % 7 != 2]
    one = Counter(t for k in learned for t in tokens[k][1:])
    two = Counter(p for k in learned for p in zip(tokens[k], tokens[k][1:]))
    n, v = one.total(), len(one)
    ratios = Counter()
    for k in learned:
        for a, b in zip(tokens[k], tokens[k][1:]):
            given = max(value(two[a, b]) - 1, 0) / max(value(one[a]) - 1, 1)
            single = max(value(one[b]), 1) / (n + v)
            ratios[level(one[a]), max(-200, min(200, round(4 * math.log2(given / single)))) if given > 0 else -1000] += 1
    weight = langmodel.interpolation([(a, r, t) for (a, r), t in ratios.items()])

    def log10(a, b):
        w = weight[level(one[a])]
        return math.log10(w * min(1, value(two[a, b]) / max(value(one[a]), 1)) + (1 - w) * (value(one[b]) + 1) / (n + v + 1))

    return {k: sum(log10(a, b) for a, b in zip(t, t[1:])) for k, t in tokens.items()}


def test_language_model_is_tuned_on_all_training_documents(spark, monkeypatch):
    monkeypatch.setattr(langmodel, "TUNING", 1, raising=False)
    rows = [(i, f"a b c{i % 3} e{i % 2} f") for i in range(120)]
    got = {r["doc_id"]: r["score"] for r in langmodel.op4_language_model(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == pytest.approx(language_model_plain(rows))


@pytest.mark.parametrize("room", [10, 1 << 23, 1 << 25, 1 << 30])
def test_language_model_counts_what_is_below_the_cutoffs(spark, monkeypatch, room):
    monkeypatch.setattr(langmodel, "ROOM", room)
    rows = [(i, f"a b c{i % 3} d{i % 40} e{i} f{i % 7} a g{i % 11} b") for i in range(120)] + [(1000, None), (1001, ""), (1002, "a z{} b a")]
    d = spark.createDataFrame([*rows, (None, "a b c1 d1")], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in langmodel.op4_language_model(d).collect()}
    assert got.pop(None) < 0
    assert got == pytest.approx(language_model_plain(rows))


def test_conflicting_slots_cost_only_their_windows_and_numbers_match_exactly(spark):
    rest = "then she walks home along the narrow path beside the quiet river and tells her brother about the old tree"
    schedule = "10 kg 20 kg 30 kg 40 kg 50 kg 60 kg 70 kg 80 kg"
    items = spark.createDataFrame([(1, f"she has 3 apples and finds 3 more apples here {rest}"), (2, schedule)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"she has 4 apples and finds 5 more apples here {rest}"), (2, f"we saw {schedule} there"), (3, schedule.replace("0", "5"))], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.op1_template_decontamination(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 2)}
    assert got[1, 1]["kind"] == "reparameterised" and 0.5 < got[1, 1]["coverage"] < 1
    assert got[2, 2]["kind"] == "verbatim" and got[2, 2]["coverage"] == 1
