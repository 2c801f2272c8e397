"""Streaming forms of the batch jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siemspark.operators import normalize as N
from siemspark.operators import parse as P
from siemspark.sources import sinks


def start_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
                  available_now: bool = True) -> StreamingQuery:
    """Hands every micro-batch to ``handle``; delivery is at least once."""
    writer = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def normalize_batch(normalized_path: str, dlq_path: str, mode: str, normalized_ms: int,
                    policies: dict[str, str] | None = None):
    """Handler: raw rows to the normalized table, failures to the dead letters.

    Both appends are idempotent, so a batch that is delivered twice adds
    nothing the second time.
    """

    def handle(raw: DataFrame, batch: int) -> None:
        mapped = N.map_events(P.parse(raw), mode, normalized_ms, policies)
        rows = mapped.select("*").persist()
        try:
            sinks.append_missing(N.normalized_rows(rows), normalized_path, "logical_key",
                                 ["tenant_id", "execution_mode", "event_date"],
                                 ["event_time_seconds", "event_time_nanos", "normalized_event_id"])
            failed = rows.where(F.col("error_code").isNotNull()).select(
                F.concat_ws(":", "raw_event_id", F.sha2("payload", 256)).alias("dedup_id"),
                "tenant_id", "raw_event_id", "error_code", "parser_id",
                F.sha2("payload", 256).alias("original_payload_sha256"))
            sinks.append_missing(failed, dlq_path, "dedup_id")
        finally:
            rows.unpersist()

    return handle


def drop_repeats(stream: DataFrame, id_col: str, time_col: str, lateness: str) -> DataFrame:
    """Repeated deliveries within the watermark are dropped."""
    return stream.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark([id_col])


def windowed_counts(stream: DataFrame, time_col: str, lateness: str, window: str, by) -> DataFrame:
    """Counters per tumbling window, closed when the watermark has passed."""
    return (stream.withWatermark(time_col, lateness).groupBy(F.window(time_col, window), *by)
            .agg(F.count(F.lit(1)).alias("events"), F.sum("bytes").alias("bytes")))


def end_of_source(rows: DataFrame, seconds_col: str, ahead_s: int) -> DataFrame:
    """One row that closes a finite source: ``ahead_s`` past its last time, every other column null.

    Sent last, it moves the watermark past all windows, so that none stays open.
    """
    last = rows.agg((F.max(seconds_col) + ahead_s).alias(seconds_col))
    return last.select(*[F.col(c) if c == seconds_col else F.lit(None).cast(rows.schema[c].dataType).alias(c)
                         for c in rows.columns])


# Consumers, the mode they work in, and the subject they read.
CONSUMERS = {"live": ("LIVE", "raw.persisted"), "replay-history": ("REPLAY", "raw.persisted"),
             "test": ("TEST", "raw.persisted"), "replay-selected": ("REPLAY", "raw.replay")}


def start_consumers(stream: DataFrame, write: Callable[[DataFrame, str], StreamingQuery]) -> list[StreamingQuery]:
    """One independent query per consumer, each with its own checkpoint.

    Live, historical replay and test each read every persisted record in their own
    mode; only the selective replay has a subject of its own.
    """
    return [write(stream.where(F.col("subject") == subject).withColumn("execution_mode", F.lit(mode)), name)
            for name, (mode, subject) in CONSUMERS.items()]
