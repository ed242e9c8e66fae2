"""Structured Streaming forms: ingestion, change-driven invalidation, sessions, rate limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry.sources.store import DocumentStore


def file_stream(spark: SparkSession, path: str, glob: str = "*", max_files: int = 1000) -> DataFrame:
    """Files as they arrive, at most ``max_files`` a batch."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).load(path)


def ingest(files: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs ``process`` on each batch and writes it as one folder, ``batch=<id>``.

    A batch that is tried again overwrites its own folder, so each file counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_store(files: DataFrame, process: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]], store: DocumentStore, checkpoint: str, source: str = "files") -> StreamingQuery:
    """Runs ``process`` (documents, chunks and vectors of files) on each batch and puts its documents in place of those that the store has.

    A batch that is tried again is committed once.
    """
    return files.writeStream.foreachBatch(lambda batch, number: store.replace(*process(batch), batch=(source, number))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def on_changes(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each batch of the change log (doc_id) to ``apply``, distinct ids only."""
    return changes.writeStream.foreachBatch(lambda batch, number: apply(batch.select("doc_id").distinct(), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def idle_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "24 hours", late: str | None = None) -> DataFrame:
    """``key, started_at, last_at, n``: activity parted by gaps; with ``late``, as a stream."""
    timed = events.withWatermark(ts, late) if late else events
    return timed.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.max(ts).alias("last_at")).select(key, F.col("w.start").alias("started_at"), "last_at", "n")


def rate_limit(events: DataFrame, most: int, key: str = "user_id", ts: str = "ts", width: str = "1 minute", late: str | None = None) -> DataFrame:
    """``key, window_start, n`` for windows with more than ``most`` events."""
    timed = events.withWatermark(ts, late) if late else events
    return timed.groupBy(key, F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > most).select(key, F.col("w.start").alias("window_start"), "n")


def answer_frames(events: list[dict]) -> list[str]:
    """Server-sent event frames of an answer's events."""
    import json

    return [f"data: {json.dumps(e, ensure_ascii=False)}\n\n" for e in events]
