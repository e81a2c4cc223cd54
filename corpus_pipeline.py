"""From raw documents to training sequences: each stage reads what the one before wrote.

In every stage null texts count as empty, repeated rows are judged each and alike, further columns stay and may have any
names, and an empty table gives an empty one; ties are settled as each stage says."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm import exact_dedup, ngram_join, packing, quality_rules, suffix_dedup
from tallyfield.llm.common import save, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject; null and empty texts go, having too few words."""
    return quality_rules.keep_good(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id; a null id is smaller than all others."""
    return exact_dedup.keep_distinct(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles the one with the smallest doc_id;
    a null id goes if its group has an id.  Texts without words link with nothing."""
    return ngram_join.keep_one(docs, size=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages of 50 bytes or more that a document with a smaller doc_id has (a null id is the smallest), and without
    documents of which nothing is left; n_chars is counted anew."""
    return suffix_dedup.trim(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048: a row for each piece; an empty text is a piece of one token."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", sequences),
]

#: SQL cannot express the tokenizer; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
