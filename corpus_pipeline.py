"""The corpus pipeline: stages over documents, each written as Parquet and read back for the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return
the columns of documents. SQL can't express the first, third and last stage; tests hold the whole against a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, line_dedup, ngram_join, quality
from tidemark.llm.common import materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose ranking score reaches the cut."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates; n_chars follows the text."""
    kept = line_dedup.drop_recurring(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones."""
    return ngram_join.distinct_documents(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left: all columns but text, with ids and n_tokens in place of any of these names."""
    import public_tokenizers as known

    coded = bpe.encode(docs, known.path("byte_bpe_multi_50k.tiktoken"), known.PATTERN)
    return coded.withColumn("n_tokens", F.size("ids").cast("long")).drop("text")


STAGES = [
    ("quality_ranking", quality_stage),
    ("line_templates", line_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("byte_bpe", token_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
