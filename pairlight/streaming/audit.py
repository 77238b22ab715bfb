"""Audit events as a stream: file sink and counts per time window."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pairlight.operators.audit import audit_rows

# Shape of a stored interaction check.
CHECK_SCHEMA = (
    "timestamp timestamp, event string, request_id string, endpoint string, rxcui_a string, rxcui_b string, "
    "evidence_status string, llm_mode string, latency_ms double, error_category string"
)


def read_checks(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(CHECK_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def sink(events: DataFrame, event: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Append the fixed fields of each event to JSON files until the source is used up."""
    return (
        audit_rows(events, event).writeStream.format("json").option("path", folder)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )


def counts(checks: DataFrame, width: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Checks per window, endpoint, status and mode; a window is closed once the watermark has passed it."""
    return (
        checks.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", width), "endpoint", "evidence_status", "llm_mode")
        .agg(F.count("*").alias("n_requests"), F.avg("latency_ms").alias("avg_latency"))
        .select(F.col("window.start").alias("window_start"), "endpoint", "evidence_status", "llm_mode", "n_requests", "avg_latency")
    )


GROUP = ["window_start", "endpoint", "evidence_status", "llm_mode"]
#: Sums, not means: rows of one window (its count when it closes, late rows later) can be added up.
WINDOW_SCHEMA = "window_start timestamp, endpoint string, evidence_status string, llm_mode string, n_requests bigint, sum_latency double, n_late bigint"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and sums per group within each batch, so that a busy group sends few rows."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by(GROUP).aggregate([("latency_ms", "sum"), ([], "count_all")])
        table = table.rename_columns([*GROUP, "total", "n"]).select([*GROUP, "n", "total"])
        yield from table.to_batches()


class _Window(StatefulProcessor):
    """Counts of a group, kept until the watermark has passed its window's end."""

    def __init__(self, width_ms: int):
        self.width_ms = width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n bigint, total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, total = 0, 0.0
        for row in rows:
            n, total = n + row["n"], total + (row["total"] or 0.0)
        end = round(key[0].timestamp() * 1000) + self.width_ms
        if end <= timerValues.getCurrentWatermarkInMs():
            yield self._row(key, 0, 0.0, n)
            return
        old = self.sums.get() if self.sums.exists() else None
        if old is None:
            self.handle.registerTimer(end)
        self.sums.update((n + (old[0] if old else 0), total + (old[1] if old else 0.0)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, total = self.sums.get()
        self.sums.clear()
        yield self._row(key, n, total, 0)

    @staticmethod
    def _row(key, n: int, total: float, late: int) -> Row:
        return Row(**dict(zip(GROUP, key, strict=True)), n_requests=n, sum_latency=total, n_late=late)

    def close(self) -> None:
        pass


def windows_with_late(checks: DataFrame, width_seconds: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """Checks per window, endpoint, status and mode, without losing any: append rows of WINDOW_SCHEMA.

    Policy for late data: a window takes rows until the watermark (the newest time of all earlier triggers less
    `lateness`) has reached its end. It then gives one row with its count and leaves the state. A row that comes for such
    a window changes no count that was given; it is counted in n_late of a row of its own. Rows without a time belong to
    no window and are left out. Start the query inside `session.state_on_disk`.
    """
    start = F.window("timestamp", f"{width_seconds} seconds")["start"]
    # The window's start is a plain time: the operator then gets late rows as well.
    rows = checks.where("timestamp is not null").withWatermark("timestamp", lateness).select(
        F.timestamp_micros(F.unix_micros(start)).alias("window_start"), "endpoint", "evidence_status", "llm_mode", F.col("latency_ms").cast("double").alias("latency_ms"))
    parts = rows.mapInArrow(_summed, "window_start timestamp, endpoint string, evidence_status string, llm_mode string, n bigint, total double")
    return parts.groupBy(*GROUP).transformWithState(_Window(width_seconds * 1000), WINDOW_SCHEMA, "append", "eventTime")
