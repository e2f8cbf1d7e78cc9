"""Writing: a dataset's records, splits, metadata and card, run logs, and copies of its media."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import state
from ..session import cut, exists


def flat(df: DataFrame, columns: list[str]) -> DataFrame:
    """columns of df, lists joined by ";"."""
    kinds = dict(df.dtypes)
    return df.select(*(F.array_join(F.transform(c, lambda x: x.cast("string")), ";").alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns))


def write_labels_csv(df: DataFrame, columns: list[str], path: str) -> None:
    flat(df, columns).write.option("header", True).mode("overwrite").csv(path)


def write_splits(df: DataFrame, path: str, kind: str = "json") -> None:
    """One folder a split."""
    df.write.partitionBy("split").mode("overwrite").format(kind).save(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append(df: DataFrame, path: str) -> None:
    """Rows put to a Parquet table, or the first of one."""
    df.write.mode("append").parquet(path)


def cache_put(entries: DataFrame, path: str, now: Column) -> None:
    """Entries (key, payload) put to a cache, stamped; readers take the latest of a key."""
    append(entries.withColumn("cached_at", now), path)


def write_features(df: DataFrame, path: str) -> None:
    """Aligned features (clip_id, modality, values: rows of numbers), one folder a modality."""
    df.write.partitionBy("modality").mode("overwrite").parquet(path)


def write_tensors(df: DataFrame, path: str) -> None:
    """Stacked rows of a split: clip_id, label and one array a modality, in order of clip_id within a file, one folder a split."""
    df.repartition("split").sortWithinPartitions("split", "clip_id").write.partitionBy("split").mode("overwrite").parquet(path)


def write_segments(segments: DataFrame, key: str, path: str) -> None:
    """One JSON object a video: its segments in order, and how many."""
    items = F.array_sort(F.collect_list(F.struct("start", "end", *(c for c in segments.columns if c not in (key, "start", "end")))))
    segments.groupBy(key).agg(F.count("*").alias("count"), items.alias("segments")).write.mode("overwrite").json(path)


def metadata(records: DataFrame) -> DataFrame:
    """One row: how many records, and their shortest, longest and mean duration."""
    return records.agg(F.count("*").alias("n"), F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"), F.avg("duration").alias("avg_duration"))


def dataset_card(records: DataFrame, title: str) -> str:
    """Markdown from a few aggregates."""
    about = metadata(records).first().asDict()
    labels = records.groupBy("final_emotion").count().orderBy("final_emotion").collect()
    return "\n".join([f"# {title}", "", "```json", json.dumps(about, default=str), "```", "", "| label | clips |", "|-|-|", *(f"| {r[0]} | {r[1]} |" for r in labels), ""])


def copy_media(records: DataFrame, copy: Callable[[str, str], None], source: str = "clip_path", target: str = "exported_clip_path") -> DataFrame:
    """Copies each record's media on the executors; clip_id and error (null: copied). copy must be safe to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    copy(a, b)
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string())], names=["clip_id", "error"])

    return records.select(F.col("clip_id").cast("string"), source, target).mapInArrow(run, "clip_id string, error string")


def upsert_partitions(source: DataFrame, path: str, keys: list[str], columns: list[str], partition: str) -> list:
    """Copy on write: rows of source put to a Parquet table that is partitioned by a column; the partitions that were written again.

    Rows that the table has get source's `columns`, others come in whole (state.upsert). Only partitions that source has
    rows of are read and written; files of others stay as they are. `partition` must follow from the keys, and source has
    a key once. The merged rows are cut from the table first, and Spark moves whole partitions into place when the job is
    done, so a job that fails leaves the table as it was.
    """
    spark = source.sparkSession
    touched = sorted((r[0] for r in source.select(partition).distinct().collect()), key=str)  # folders of the table
    if not exists(spark, path):
        source.write.partitionBy(partition).parquet(path)
        return touched
    held = spark.read.parquet(path)
    some = held.filter(F.col(partition).isin([x for x in touched if x is not None]) | (F.col(partition).isNull() if None in touched else F.lit(False)))
    merged = cut(state.upsert(some, source, keys, columns, tuple(c for c in held.columns if c not in (*keys, *columns))).drop("change"))
    merged.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return touched


def write_batch_results(results: DataFrame, path: str) -> DataFrame:
    """Keeps a batch's responses (video_path, gcs_uri, segments as JSON text, error) as JSON, and gives the summary: video_path, or else gcs_uri, segments ([] if there are none), error."""
    results.write.mode("overwrite").json(path)
    return results.select(F.coalesce(F.nullif("video_path", F.lit("")), "gcs_uri").alias("video_path"), F.coalesce("segments", F.lit("[]")).alias("segments"), "error")
