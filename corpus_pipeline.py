"""A training corpus in stages: quality rules, near duplicates, benchmark passages, source mix, shards.

Every stage takes documents with any further columns, whatever their names, and all but the last give the same
columns. A null text counts as an empty one; it fails the quality rules (few words), so later stages meet none in a
row, though each takes them alone. Very long texts are handled whole, a text in one task. Rows that repeat are rows of
their own to all stages but near_duplicates. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cutroom.llm import decontaminate, near_dedup, quality_rules, sharding, source_mix
from cutroom.llm.session import Shelf, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps. Rows with null doc_id, and repeated rows, are judged like any other."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest doc_id. Rows that repeat a doc_id are one document; rows without doc_id all stay."""
    return near_dedup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. A benchmark without words keeps all."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. Null is a source of its own; documents without words go; of equal rows it is the same number in every run."""
    return source_mix.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row of the mix: doc_id, size, text_crc32, law, shard, slot and grown_shard. A null doc_id is a key like any other."""
    return sharding.shard_documents(docs, 16)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("shards", shards),
]

#: Near duplicates can't be expressed in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again by the next."""
    shelf, docs = Shelf(spark), table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        done, docs = docs, shelf.put(stage(spark, docs, sf_dir))
        if n:
            shelf.free(done)
    return STAGES[-1][1](spark, docs, sf_dir)
