"""A corpus through five operators of ``llm``: every stage works on all its predecessor kept.

Every stage but the last takes and returns the columns of ``documents`` and has all its decisions take effect: toxic documents go;
lines that fail the quality rules go, and documents that lose too much by it; of each group of near-duplicates one document
stays; passages that occur more than once go from the texts. What nulls, blank texts, repeated rows, empty tables and extra
columns become is stated with each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import line_quality, packing, repeats, simhash, toxicity
from llm.common import fold_of, ready, table
from llm.queries import BYTE_BPE
from tidesift.operators.staging import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the lexicon is learned as in the operator's query."""
    ready(spark)
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=fold_of("doc_id", 4) != 2)
    return toxicity.reject(docs, lexicon)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failed lines."""
    ready(spark)
    return line_quality.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ready(spark)
    return simhash.keep_one_per_group(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur more than once."""
    ready(spark)
    return repeats.remove_repeats(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    ready(spark)
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", apply_quality_rules),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("packing", pack_documents),
]

# A learned lexicon, fingerprints and tokens have no SQL counterpart; tests hold the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
