"""Corpus pipeline: quality rules, quality classifier, line dedup, SimHash near-dedup, packing.

Each stage reads its predecessor's written Parquet as ``docs`` and calls one operator of
``outreach_spark.llm``; ``run`` applies them to the documents of ``sf_dir``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from outreach_spark.llm import op03_line_winnow as op3
from outreach_spark.llm import op05_rff_quality as op5
from outreach_spark.llm import op06_simhash_trie as op6
from outreach_spark.llm import op08_harmonic_packing as op8
from outreach_spark.llm import op10_quality_rules as op10
from outreach_spark.llm.common import cut, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return op10.filter_documents(docs, read_table(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3 go."""
    return op5.filter_documents(docs, read_table(spark, sf_dir, "labels"), threshold=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 50 words or more that occurred before lose their lines; every document stays."""
    return op3.dedup_lines(docs, min_words=50)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: four-word shingles, at most four differing bits."""
    return op6.keep_one_per_group(docs, words=4, max_bits=4)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 ids."""
    return op8.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: The classifier, the fingerprints and the tokenizer cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
