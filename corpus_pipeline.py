"""A corpus from raw documents to packed sequences, in five stages.

run(spark, sf_dir) applies STAGES to the table documents, each to all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumbra.llm import lines, mixing, packing, quality, simhash
from lumbra.llm.common import read, written

#: A document is rejected below this score: the classifier's own threshold, lowered so that doubtful documents stay.
REJECT = 0.02


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")), REJECT)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines the first stays."""
    return lines.remove(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the first document stays: candidates by SimHash fingerprints, 5-word Jaccard similarity of 0.8 or more."""
    return simhash.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out, so that sources meet their targets."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [("quality", classify), ("lines", dedup_lines), ("near-duplicates", dedup_documents), ("mixing", mix), ("packing", pack)]
#: Stages that SQL can't express: trained scores, MinHash, tokenizer ids. Tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
