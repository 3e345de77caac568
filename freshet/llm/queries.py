"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": sql.NEAR_DUPLICATES,
    "op8_quality_divergence": sql.QUALITY,
    "op11_hard_negatives": sql.HARD_NEGATIVES,
    "op12_ns_kmeans": sql.KMEANS,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op2_ngram_jaccard_join(spark, sf_dir):
    from freshet.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_best_two_fit_packing(spark, sf_dir):
    from freshet.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


@query
def op8_quality_divergence(spark, sf_dir):
    from freshet.llm.quality import STRICT, quality

    # digits that do not depend on the order of sums
    rounded = {c: F.round(c, 6) for c in ("char_distance", "word_distance")}
    return quality(table(spark, sf_dir, "documents"), STRICT).withColumns(rounded)


@query
def op6_benchmark_decontamination(spark, sf_dir):
    from freshet.llm.decontaminate import benchmark_passages

    return benchmark_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_pii_anchor_expansion(spark, sf_dir):
    from freshet.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


@query
def op5_context_tree_scoring(spark, sf_dir):
    from freshet.llm.ctw import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


@query
def op10_secret_scan(spark, sf_dir):
    from freshet.llm.secrets import secrets

    return secrets(table(spark, sf_dir, "documents"))


@query
def op1_html_best_region(spark, sf_dir):
    from freshet.llm.html_text import extracted

    return extracted(table(spark, sf_dir, "pages"))


@query
def op7_toxicity_chain(spark, sf_dir):
    from freshet.llm.toxicity import chain_scores

    labels = table(spark, sf_dir, "labels").selectExpr("doc_id", "1 - quality AS low_quality", "toxic")
    scores = chain_scores(table(spark, sf_dir, "documents"), labels, ["low_quality", "toxic"])
    return scores.select("doc_id", "is_toxic", "p_toxic", "p_low_quality")


@query
def op9_language_fusion(spark, sf_dir):
    from freshet.llm.language import page_languages

    return page_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query
def op11_hard_negatives(spark, sf_dir):
    from freshet.llm.hard_negatives import hard_negatives, vector_rows

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vector_rows(table(spark, sf_dir, "embeddings"), label, 256), F.col("vec_id") % 100 == 0)


@query
def op12_ns_kmeans(spark, sf_dir):
    from freshet.llm.ns_kmeans import clustered

    return clustered(table(spark, sf_dir, "embeddings"))


@query
def op13_url_filter(spark, sf_dir):
    from freshet.llm.url_filter import judged

    return judged(table(spark, sf_dir, "pages"))
