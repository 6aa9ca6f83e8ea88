"""The corpus pipeline: quality rules, near-duplicate removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes each
result as Parquet to the shared folder and reads it back as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallow.llm import jaccard, mixing, packing, quality
from tallow.llm.common import stage, table, unstage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, without their failing lines. Null, empty and short texts (under 50 words) go; repeated rows stay; an empty table gives none."""
    return quality.clean_documents(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: links are five-word shingles with a similarity of 0.8 or more. Null ids, repeated rows and texts without words: see first_of_each_class."""
    return jaccard.first_of_each_class(docs, n=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target asks for, one of each source cut at the budget. Documents without words go; a null source is one of its own."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences, one row each (see packing.pack). A null text is one end token; repeated documents are packed each."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", ngram_jaccard_join), ("mixing sources to target weights", mix_sources), ("best-fit packing", pack_sequences)]

# Hashes, tokenizers and similarity joins: SQL cannot express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, f) in enumerate(STAGES):
        done = stage(f(spark, docs, sf_dir), f"pipeline-{k}")
        if k:
            unstage(docs)
        docs = done
    return docs
