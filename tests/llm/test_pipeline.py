import corpus_pipeline
from fieldqueue.llm import language
from tests.llm import plain

SF = "/root/testdata/sf0.01"


def test_stages_in_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources"]


def test_stages_equal_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r["doc_id"] for r in df.collect()}

    kept = stages["language ID"](spark, docs, SF).cache()
    assert kept.columns == names
    lettered = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert ids(kept) <= lettered and len(ids(kept)) >= 0.99 * len(lettered)

    cleaned = stages["line dedup"](spark, kept, SF).cache()
    before = {r["doc_id"]: r["text"] for r in kept.collect()}
    want = plain.line_dedup(before.items())
    want = {k: t for k, t in want.items() if t == before[k] or t.strip(" \t\r\n\x0b\x0c")}
    got = {r["doc_id"]: r for r in cleaned.collect()}
    assert {k: r["text"] for k, r in got.items()} == want and cleaned.columns == names
    assert all(r["n_chars"] == len(r["text"]) for k, r in got.items() if r["text"] != before[k])

    single = stages["n-gram Jaccard join"](spark, cleaned, SF).cache()
    groups = plain.jaccard_components(list(want.items())[:0] or [(k, t) for k, t in want.items() if k < 300])
    assert {k for k in ids(single) if k < 300} <= set(groups) and all(v[1] == k for k, v in groups.items() if k in ids(single))
    assert single.columns == names

    clean = stages["benchmark decontamination"](spark, single, SF).cache()
    index = {}
    items = {r["item_id"]: plain.words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for i, w in items.items():
        for j in range(len(w) - 5):
            index.setdefault(tuple(w[j : j + 6]), set()).add((i, j))
    held = set()
    for r in single.collect():
        w, hit = plain.words(r["text"]), {}
        for j in range(len(w) - 5):
            for i, p in index.get(tuple(w[j : j + 6]), ()):
                hit.setdefault(i, set()).update(range(p, p + 6))
        if any(len(p) >= min(13, 0.5 * len(items[i])) for i, p in hit.items()):
            held.add(r["doc_id"])
    assert ids(clean) == ids(single) - held and held and clean.columns == names

    mix = stages["mixing sources"](spark, clean, SF).toPandas()
    assert set(mix.doc_id) <= ids(clean) and (mix.copies >= 1).all() and (mix.copies <= 2).all()
    by = mix.groupby("source").agg({"taken": "sum", "target": "first"})
    assert ((by.taken - by.target).abs() <= 0.05 * by.target + 50).all()


def test_stages_take_odd_rows_and_clashing_columns(spark):
    rows = [(1, None, "en", "a", 0, "z"), (2, "", None, None, 0, "z"), (3, "the cat sat on the mat", "en", "a", 22, "z"), (3, "the cat sat on the mat", "en", "a", 22, "z"), (4, "der Hund und die Katze", "de", "b", 22, None), (None, "le chien et le chat", "fr", None, 19, "z"), (5, "the " * 200_000, "en", "b", 800_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").withColumnRenamed("score", "n_removed")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
    kept = corpus_pipeline.identify_language(spark, docs.withColumnRenamed("n_removed", "lang_pred"), SF)
    assert {r["doc_id"] for r in kept.collect()} == {3, 4, 5, None} and kept.columns[-1] == "lang_pred"


def test_run_gives_rows(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 50 and "doc_id" in out.columns


def test_scores_of_short_clean_texts_are_not_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    short = spark.createDataFrame([(1, "It."), (2, "und"), (3, "La."), (4, "I")], "doc_id long, text string")
    assert all(r["score"] >= corpus_pipeline.LEAST_SCORE for r in language.identify(short, model).collect())
