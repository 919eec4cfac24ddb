"""Corpus preparation: language ID, line dedup, near-duplicate removal, decontamination and source mixing, each over what the stage before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldqueue.llm import decontaminate, jaccard, language, lines, mixing
from fieldqueue.llm.shared import kept, without
from fieldqueue.sources.shared import forget
from fieldqueue.sources.tables import table

#: Documents whose language is found with less probability go.
LEAST_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have letters and a language that the model finds with LEAST_SCORE or more.

    The model learns from the documents' own `lang`. All columns stay as they are.
    """
    names = docs.columns
    model = language.train(docs.select("doc_id", "text", "lang"))
    # under other names no column of the documents clashes with what is found
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    found = language.identify(plain, model, text=f"c{names.index('text')}")
    return found.where((F.col("lang_pred") != language.NONE) & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score").toDF(*names)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages of lines; n_chars follows. A document of which nothing is left goes."""
    names = docs.columns
    own = {"doc_id": "doc_id", "text": "text", "n_chars": "n_chars"}
    out = lines.line_dedup(docs.toDF(*[own.get(c, f"c{i}") for i, c in enumerate(names)]))
    out = out.where((F.col("n_removed") == 0) | (F.length(F.trim(F.translate("text", "\n\r\t\x0b\x0c", "     "))) > 0))
    if "n_chars" in names:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, size).otherwise(F.col("n_chars")))
    return out.drop("n_lines", "n_removed").toDF(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays."""
    groups = jaccard.jaccard_join(docs)
    return without(docs, groups.where((F.col("n_shingles") > 0) & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id"))


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, as it is or with other numbers, names or units."""
    return without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, source, size, copies and words taken of each document that is taken at all."""
    return mixing.pareto_mix(docs).where("copies > 0").select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_documents),
    ("mixing sources", mix_sources),
]

#: Language ID and the template windows have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again before the next, which makes those before it superfluous."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, kept(stage(spark, docs, sf_dir))
        if i:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
