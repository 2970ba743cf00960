"""The registered queries of this subpackage; ``oracle`` has SQL where SQL can express them."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import (classifier, conversations, language, licenses, packing, pages, phrases,
                           pieces, rules, shards, simhash, vectors)
from shelfmark.sources.tables import read_table


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file on every machine."""
    return importlib.import_module("public_tokenizers").path(name)


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return simhash.near_duplicates(read_table(spark, sf, "documents"))


def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """License phrases and notices in all documents."""
    return licenses.scan_licenses(read_table(spark, sf, "documents"))


def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Unigram token counts of all documents."""
    return pieces.count_tokens(read_table(spark, sf, "documents"),
                               tokenizer_file("piece_bpe_32k.model"))


def op4_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """All documents encoded, and their ids decoded again: digests of both."""
    path = tokenizer_file("piece_bpe_32k.model")
    documents = read_table(spark, sf, "documents")
    return pieces.decode(pieces.encode(documents, path), path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"), F.length("text").cast("bigint").alias("n_chars"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and verdict for all documents."""
    return rules.judge(read_table(spark, sf, "documents")).drop("n_lines")


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents packed into sequences: digests of the pieces."""
    pieces_of_all = packing.pack(read_table(spark, sf, "documents"),
                                 tokenizer_file("byte_bpe_50k.json"))
    return pieces_of_all.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


def op7_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Quality scores of all documents."""
    return classifier.classify(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


def op8_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate groups of all vectors."""
    return vectors.near_duplicates(read_table(spark, sf, "embeddings"))


def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """All documents dealt to shards."""
    return shards.assign(read_table(spark, sf, "documents"))


def op10_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """The main text of all pages."""
    return pages.extract(read_table(spark, sf, "pages"))


def op11_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """The language of all documents, learned from the rows the contract allows."""
    return language.identify(read_table(spark, sf, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """The first 2000 collocations of every lang of all documents."""
    return phrases.collocations(read_table(spark, sf, "documents"))


def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations, damaged by the contract's rule, audited and repaired."""
    return conversations.repair(read_table(spark, sf, "conversations"))


REGISTRY = {
    "op1_simhash": op1_simhash,
    "op2_license_scan": op2_license_scan,
    "op3_token_counts": op3_token_counts,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality_rules": op5_quality_rules,
    "op6_packing": op6_packing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_sharding": op9_sharding,
    "op10_html_extraction": op10_html_extraction,
    "op11_language_id": op11_language_id,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_conversation_repair": op13_conversation_repair,
}
