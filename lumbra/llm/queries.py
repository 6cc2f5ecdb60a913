"""The registered queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, lines, media, mixing, packing, pii, quality, secretscan, simhash, substring
from .common import read, written


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(read(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(media.encode_texts(read(spark, sf_dir, "documents")), "media")
    return media.digests(stored)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_substring, op2_pii, op3_simhash, op4_lines, op5_packing, op6_fingerprints, op7_quality, op8_mixing, op9_media, op10_secrets)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {}
