"""Corpus pipeline: quality rules, near duplicates, PII, source mix and packing, over documents.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import forget, written
from newsloom.llm.jaccard import one_of_each
from newsloom.llm.mixing import mixed_documents
from newsloom.llm.packing import pack_documents
from newsloom.llm.pii import mask_pii
from newsloom.llm.quality import remove_lines


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the line frequencies reject, without the frequent lines of their hosts."""
    return remove_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by the name of its kind; n_chars follows the text."""
    masked = mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of documents, or pieces of long ones."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", private_data),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", packing),
]
#: Components, learned classifiers and packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        found = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            found = written(found, f"stage-{k}")
            forget(docs)  # does nothing to a table that it has not written
        docs = found
    return docs
