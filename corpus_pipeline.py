"""The corpus pipeline: documents to packed sequences, by five operators of bandweave.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
docs; all but the last return the columns of documents. Stages work on whatever their predecessor kept. An empty
table passes through; what each stage does with nulls, ties and repeated rows is said in its operator's module. In
short: a null or empty text fails the quality rules; of rows that repeat a doc_id one is kept by near-dedup; a
document that the mix takes several times is that many rows, packed one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bandweave.llm import minhash, mixing, packing, pii, quality_rules
from bandweave.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; labels give trusted ones."""
    return quality_rules.keep_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near duplicates (5 words, 0.8)."""
    return minhash.deduplicated(docs, width=5, percent=80)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal numbers, dates and addresses replaced."""
    return pii.stage(docs, pii.TRIAL_KEY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the sources' targets, repeated where a target is larger than its source."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("pii", pseudonyms), ("mix", mix), ("packing", pack)]

#: SQL can't express the hashed n-gram model, the pseudonyms or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i}")
    return docs
