"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of ``documents``.
Nulls: a row without text fails the quality rules. In the second and third stage rows are told apart by a 64-bit hash of
all their columns, so rows without an id and different texts under one id are judged like all others; rows that repeat
in full count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.decontaminate import benchmark_passages
from freshet.llm.ngram_join import near_duplicates
from freshet.llm.packing import pack
from freshet.llm.pii import masked_documents
from freshet.llm.quality import kept_documents
from freshet.session import durable

KEY = "__row"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a column that tells its rows apart, and rows that repeat in full not."""
    return docs.withColumn(KEY, F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in docs.columns]))


#: several stages (verified links, packing ranks, tokenizer) have no SQL form
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and do not diverge from their language."""
    return kept_documents(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, one without an id only where none has one."""
    rows = _keyed(docs)
    groups = near_duplicates(rows.select(F.col(KEY).alias("doc_id"), "text")).toDF(KEY, "n_shingles", "component")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", KEY)
    first = rows.select(KEY, "doc_id").join(groups, KEY).groupBy("component").agg(F.min(order).alias("x")).select(f"x.{KEY}")
    return rows.join(durable(first), KEY, "left_semi").dropDuplicates([KEY]).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _keyed(docs)
    found = benchmark_passages(rows.select(F.col(KEY).alias("doc_id"), "text"), benchmark)
    return rows.join(durable(found.select(F.col("doc_id").alias(KEY)).distinct()), KEY, "left_anti").select(docs.columns)


def personal_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind."""
    return masked_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' token pieces in sequences of at most 2048 tokens."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("pii", personal_data_masked),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
