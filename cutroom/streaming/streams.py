"""Structured Streaming forms. Session windows and watermarks are extensions; the batch forms decide what is right."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.retries import MOST_ERRORS, POLL_S, WAIT_S
from ..session import exists
from ..sources.tables import VIDEO_FILES, is_media


def inbox(spark: SparkSession, folder: str, extensions: tuple[str, ...] = VIDEO_FILES) -> DataFrame:
    """New media files as they come; the query's checkpoint remembers those seen."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "modificationTime", "length").filter(is_media(F.col("path"), extensions))


def sessions(events: DataFrame, key: str, at: str = "ts", gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """start, end and count of each key's runs of events without a longer gap. Extension."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def heartbeats(beats: DataFrame, key: str = "worker_id", at: str = "ts", idle: str = "300 seconds", idle_ms: int = 300_000) -> DataFrame:
    """worker, last_seen and state: `alive` at each batch with a beat, `gone` once the watermark is idle_ms past the last beat."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"worker": [str(k[0])], "last_seen": [pd.Timestamp(last, unit="ms")], "state": ["gone"]})
            return
        last = max([*(int(f[at].max().timestamp() * 1000) for f in frames), *(state.get if state.exists else ())])
        state.update((last,))
        state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"worker": [str(k[0])], "last_seen": [pd.Timestamp(last, unit="ms")], "state": ["alive"]})

    return (
        beats.withWatermark(at, idle)
        .groupBy(key)
        .applyInPandasWithState(step, "worker string, last_seen timestamp, state string", "last long", "update", GroupStateTimeout.EventTimeTimeout)
    )


def run_available(df: DataFrame, sink, checkpoint: str, mode: str = "append"):
    """Runs over all that is there and stops; sink gets (batch, id)."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return query


_LEDGER = "batch_id long, n long"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """batch_id and n of the batches that the table at path has whole."""
    where = f"{path}/_ledger"
    return spark.read.schema(_LEDGER).json(f"{where}/*") if exists(spark, where) else spark.createDataFrame([], _LEDGER)


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch that takes each batch once, however often it is replayed.

    A batch's rows are the partition batch_id of the table at path, then the ledger gets its number. A batch that the
    ledger has changes nothing; one that broke off before is written over its own partition. One stream writes a table.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = f"{path}/_ledger/{batch_id}"
        if exists(spark, f"{own}/_SUCCESS"):
            return
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        n = spark.read.parquet(f"{path}/batch_id={batch_id}").count()
        spark.createDataFrame([(batch_id, n)], _LEDGER).coalesce(1).write.mode("overwrite").json(own)

    return sink


def appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of whole batches, with their batch_id."""
    rows = spark.read.schema(f"{schema}, batch_id long").parquet(path)
    return rows.join(ledger(spark, path).select("batch_id"), "batch_id", "left_semi")


def retry_policy(events: DataFrame, key: str = "worker_id", at: str = "ts", late: str = "30 seconds") -> DataFrame:
    """The rows of operators.retries.decided as events (key, at, outcome) come, and a row `retry` once the wait after an error is over.

    State of a key: errors in a row, and whether it stopped; a stopped one decides nothing more. Events of one batch are
    taken in order of at.
    """
    schema = "worker string, at timestamp, outcome string, consecutive_errors int, action string, wait_s int"

    def rows(found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=[c.split()[0] for c in schema.split(", ")])

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        errors, last, stopped = state.get if state.exists else (0, 0, False)
        if state.hasTimedOut:
            state.update((errors, last, stopped))
            yield rows([(str(k[0]), pd.Timestamp(last + WAIT_S * 1000, unit="ms"), "wait over", errors, "retry", 0)])
            return
        found, waits = [], False
        for event in pd.concat(list(frames)).sort_values(at).itertuples():
            if stopped:
                break
            outcome, when = event.outcome, getattr(event, at)
            errors = 0 if outcome == "job" else errors + (outcome == "error")
            waits = outcome == "error"
            stopped, last = errors >= MOST_ERRORS, int(when.timestamp() * 1000)
            found.append((str(k[0]), when, outcome, errors, "stop" if stopped else "wait" if waits else "go on", 0 if stopped else WAIT_S if waits else POLL_S))
        state.update((errors, last, stopped))
        if waits and not stopped:
            state.setTimeoutTimestamp(max(last + WAIT_S * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows(found)

    return (
        events.withWatermark(at, late)
        .groupBy(key)
        .applyInPandasWithState(step, schema, "errors int, last long, stopped boolean", "append", GroupStateTimeout.EventTimeTimeout)
    )
