"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfolio.llm.common import remainder, stored, table
from wayfolio.llm.decontamination import clean_documents
from wayfolio.llm.jaccard import one_of_each
from wayfolio.llm.language import known_language, learn_languages
from wayfolio.llm.mixing import mixed_documents
from wayfolio.llm.sharding import sharded_documents

SHARD_BYTES = 16 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; learned from the labels of ids whose remainder is not 2."""
    return known_language(docs, learn_languages(docs.filter(remainder(F.col("doc_id"), 4) != 2)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with Jaccard similarity of at least 0.8."""
    return one_of_each(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten consecutive words of a benchmark item."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight: documents repeated by epochs, or cut, until each source has its words."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard of about SHARD_BYTES."""
    return sharded_documents(docs, target_bytes=SHARD_BYTES)


STAGES = [
    ("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing),
    ("sharding", sharding),
]

#: Language ID is a learned model, which SQL can't repeat; tests/llm checks the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
