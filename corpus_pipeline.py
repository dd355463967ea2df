"""A corpus pipeline of four stages: quality rules, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm import mixing, packing, quality, simhash
from notelake.llm.common import materialise
from notelake.llm.queries import tokenizer_path
from notelake.session import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with their columns. Null, empty and blank texts go; rows that repeat
    stay or go each; very long texts count whole; an empty table stays empty."""
    return quality.kept_documents(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, a similarity of 0.8 or more. SimHash fingerprints
    of 64 bits link rows first, in buckets of agreeing blocks; as a pair of 0.8 mostly differs in more bits than their
    radius, rows that they leave apart meet in buckets of MinHash bands, too. An exact comparison decides. Of rows that
    repeat one stays; a pair of similarity 0.8 is missed with probability 1e-4 at most (7e-5 by its bands, 3e-5 by its
    fingerprints), others less; rows of one id with texts of different groups, and rows without id, stay in each group;
    texts without words are one group; ties go by the row's hash; an empty table stays empty."""
    ship(spark)
    return simhash.near_deduplicated(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as it passes over them. They come in the order of its slots, which is lost when
    the result is written. A null source is a source; documents without words go; rows that
    repeat are documents of their own; an empty table stays empty."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies: a row per piece. A null text is its end id alone; rows that repeat are
    packed each; very long texts are cut; an empty table packs to nothing."""
    ship(spark)
    out = packing.packed_documents(docs, tokenizer_path(), end_id=0)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality_stage), ("simhash near-dedup", dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL has no XXH64 and no tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
