"""The corpus pipeline: language ID, exact dedup, near-duplicate join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.

Null and empty texts have no language and go in the first stage.  Of repeated rows, and
of texts equal but for white space, one stays (the longest, then the smallest id); of a
group of near-duplicates the smallest id stays.  Rows with null ids take part like
others.  A very long text is one row to the last stage, where it becomes pieces.  All but
the last stage return the columns of documents, whatever these are called; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from plyframe.llm._shared import id_bucket, written

#: A document stays if its main language has at least this share of it.
MIN_LANGUAGE_SHARE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or without a main one, go."""
    model = language_id.train(docs, F.coalesce(id_bucket("doc_id", 4) != 2, F.lit(True)))
    return language_id.keep_identified(docs, model, min_score=MIN_LANGUAGE_SHARE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest stays."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document of the smallest id stays."""
    return jaccard_join.keep_one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights; a document is there once per epoch."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences of 1024 tokens."""
    return packing.pack(packing.token_pieces(docs)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The first stage is a trained model and the last a tokenizer: no SQL for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
