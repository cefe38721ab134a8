"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Null and empty texts pass all stages up to mixing,
which takes no words from them; empty tables stay empty; rows that repeat a doc_id and its text leave the n-gram join once;
rows without a doc_id are documents like others, which no other is a copy of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, ngram_join, packing, quality, substrings
from tessera.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return quality.classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("keep").select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_of_each(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    docs = docs.select(*COLUMNS)
    return substrings.cut(docs, substrings.passages(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document's taken words, once for each pass that takes some."""
    return mixing.mixed_texts(docs.select(*COLUMNS)).select(*COLUMNS)


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences' pieces with their token ids."""
    return packing.pack(docs.select(*COLUMNS))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", source_mixing),
    ("packing", curve_packing),
]

#: The classifier's fit and the tokenizer have no SQL form; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
