"""The queries of this folder's operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import centroids, contamination, katz, language, line_quality, packing, pieces, repeats, simhash, token_counts, topk, toxicity, trie
from llm.common import fold_of, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_digest(table(spark, sf_dir, "documents"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_digest(table(spark, sf_dir, "documents"), PIECES)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, budget=512)


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judged(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 50 == 0)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language.predict(documents, language.fit(documents, learn=fold_of("doc_id", 4) != 2))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(documents, toxicity.fit(documents, labels, learn=fold_of("doc_id", 4) != 2))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeats": op1_repeats,
    "op2_pieces": op2_pieces,
    "op3_token_counts": op3_token_counts,
    "op4_line_quality": op4_line_quality,
    "op5_topk": op5_topk,
    "op6_language": op6_language,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_katz": op9_katz,
    "op10_simhash": op10_simhash,
    "op11_decontamination": op11_decontamination,
    "op12_trie": op12_trie,
    "op13_centroids": op13_centroids,
}

SQL: dict[str, str] = {
    "op1_repeats": repeats.SQL,
    "op4_line_quality": line_quality.SQL,
    "op5_topk": topk.SQL,
    "op11_decontamination": contamination.SQL,
    "op12_trie": trie.SQL,
    "op13_centroids": centroids.SQL,
}
