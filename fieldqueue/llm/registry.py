"""Queries of the training-data operators over their whole tables."""

from __future__ import annotations

from fieldqueue.llm import decontaminate, hosts, importance, jaccard, langmodel, language, lexical, lines, mixing, neighbours, private, tokencount, toxicity
from fieldqueue.sources.tables import table


def over_documents(f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_template_decontamination": lambda spark, sf_dir: decontaminate.op1_template_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op2_private_data": over_documents(private.op2_private_data),
    "op3_line_windows": over_documents(lines.op3_line_windows),
    "op4_language_model": over_documents(langmodel.op4_language_model),
    "op5_toxicity": lambda spark, sf_dir: toxicity.op5_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op6_token_counts": over_documents(tokencount.op6_token_counts),
    "op7_ngram_jaccard": over_documents(jaccard.jaccard_join),
    "op8_pareto_mix": over_documents(mixing.op8_pareto_mix),
    "op9_hash_forest": lambda spark, sf_dir: neighbours.op9_hash_forest(table(spark, sf_dir, "embeddings")),
    "op10_language_id": over_documents(language.op10_language_id),
    "op11_importance_resampling": lambda spark, sf_dir: importance.op11_importance_resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op12_lexical_search": lambda spark, sf_dir: lexical.op12_lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op13_host_reputation": lambda spark, sf_dir: hosts.op13_host_reputation(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")),
}

ORACLE = {"op3_line_windows": lines.ORACLE, "op8_pareto_mix": mixing.ORACLE, "op11_importance_resampling": importance.ORACLE, "op12_lexical_search": lexical.ORACLE, "op13_host_reputation": hosts.ORACLE}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
