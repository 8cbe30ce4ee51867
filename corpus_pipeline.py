"""From raw documents to packed sequences: five stages, each a table to the next.

Rejected documents, copies but one of each group, and what the mixture doesn't take leave the
corpus; personal data is replaced in what stays; a document that the mixture takes twice is there
twice. Each stage sees all that its predecessor kept, and all but the last keep the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm.minhash import drop_near_duplicates
from loomspan.llm.mixing import mix
from loomspan.llm.packing import pack_documents
from loomspan.llm.pii import TEST_KEY, key_of, pseudonymised
from loomspan.llm.quality import quality_filter
from loomspan.plans.scratch import drop, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By the session's key; that of the tests where none is set, so set ``spark.loomspan.pii.key`` for real documents."""
    return pseudonymised(docs, key_of(spark, TEST_KEY), kinds_as=None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality rules", keep_good),
    ("minhash near-dedup", drop_copies),
    ("pii pseudonyms", hide_personal_data),
    ("source mixing", mix_sources),
    ("best-fit packing", pack),
]

#: Shingle hashes, tokens and draws of the mixture can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, and goes when its successor is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
