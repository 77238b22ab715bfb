"""Sliding-log admission per key: in batch over an event table, and as a stream with state."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pairlight import vocab

LIMIT, WINDOW = vocab.RATE_LIMIT


def admit(hits: deque, now: int, limit: int, window: int) -> tuple[bool, float]:
    """Decide one event, in microseconds, and record it if it is let in. Refused events leave no trace."""
    while hits and now - hits[0] > window:
        hits.popleft()
    if len(hits) < limit:
        hits.append(now)
        return True, 0.0
    return False, max(0, window - (now - hits[0])) / 1e6


def _with_segments(events: DataFrame, key: str, limit: int, window: int) -> DataFrame:
    """Adds _seg and _warm, so that (key, _seg) can be decided apart from each other.

    Time is cut into buckets of one window. The events of a bucket only depend on
    their own and the last bucket. A new segment starts at a bucket when the event
    before it is more than a window older, or when the two buckets before hold no
    more than `limit` events together: then every event of the last bucket is let
    in whatever came earlier, and those events, repeated as a warm-up, are all the
    segment has to know. A key with many events and pauses is so spread over many
    tasks; one that stays above half its limit in every two windows cannot be cut,
    as each decision then depends on the one before. Only counts per bucket are
    shuffled to find the cuts.
    """
    buckets = events.groupBy(key, "_bucket").agg(
        F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.count("*").alias("_n"))
    w = W.partitionBy(key).orderBy("_bucket")
    here = F.col("_bucket")
    prior = buckets.select(
        "*", F.lag("_bucket", 1).over(w).alias("_b1"), F.lag("_bucket", 2).over(w).alias("_b2"),
        F.lag("_n", 1).over(w).alias("_n1"), F.lag("_n", 2).over(w).alias("_n2"), F.lag("_hi", 1).over(w).alias("_h1"),
        F.lead("_bucket", 1).over(w).alias("_next"),
    )
    last = F.when(F.col("_b1") == here - 1, F.col("_n1")).otherwise(0)
    before = F.when(F.col("_b1") == here - 2, F.col("_n1")).when(F.col("_b2") == here - 2, F.col("_n2")).otherwise(0)
    start = F.col("_b1").isNull() | (F.col("_lo") - F.col("_h1") > window) | (last + before <= limit)
    cuts = (
        prior.withColumn("_start", start)
        .withColumn("_seg", F.count_if("_start").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("_warms", F.coalesce(F.lead("_start", 1).over(w) & (F.col("_next") == here + 1), F.lit(False)))
        .select(key, "_bucket", "_seg", "_warms")
    )
    # A bucket before a cut is read twice: as itself, and as the warm-up of the next segment.
    places = F.when(F.col("_warms"), F.array(
        F.struct(F.col("_seg").alias("s"), F.lit(False).alias("w")),
        F.struct((F.col("_seg") + 1).alias("s"), F.lit(True).alias("w")),
    )).otherwise(F.array(F.struct(F.col("_seg").alias("s"), F.lit(False).alias("w"))))
    return (
        events.join(cuts, [key, "_bucket"])
        .withColumn("_p", F.explode(places))
        .withColumn("_seg", F.col("_p.s")).withColumn("_warm", F.col("_p.w"))
        .drop("_p", "_warms", "_bucket")
    )


def admit_batch(events: DataFrame, key: str, ts: str, order: str, limit: int = LIMIT,
                window_seconds: float = WINDOW) -> DataFrame:
    """Every event with allowed and retry_after, decided per key in the order of ts, then `order`.

    Segments are sorted by Spark, which spills, and read as a stream of batches,
    so no task ever holds a whole key; what is kept is at most `limit` times.
    """
    window = round(window_seconds * 1e6)
    timed = events.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn(
        "_bucket", F.floor(F.col("_t") / F.lit(window)))
    parts = _with_segments(timed, key, limit, window).repartition(key, "_seg").sortWithinPartitions(
        key, "_seg", "_t", order)
    schema = T.StructType([*events.schema.fields, T.StructField("allowed", T.BooleanType()),
                           T.StructField("retry_after", T.DoubleType())])
    columns = events.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, hits = None, deque()
        for batch in batches:
            allowed, wait = [], []
            for k, seg, now in zip(batch[key], batch["_seg"], batch["_t"], strict=True):
                if (k, seg) != current:
                    current, hits = (k, seg), deque()
                ok, after = admit(hits, now, limit, window)
                allowed.append(ok)
                wait.append(after)
            out = batch[columns].assign(allowed=allowed, retry_after=wait)
            yield out[~batch["_warm"].to_numpy(dtype=bool)]

    return parts.mapInPandas(run, schema)


class _Log(StatefulProcessor):
    """The sliding log of one key: the times of its last admitted events."""

    def __init__(self, key: str, order: str, limit: int, window: int, ttl_ms: int | None):
        self.key, self.order, self.limit, self.window, self.ttl_ms = key, order, limit, window, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hits = handle.getListState("hits", "at bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        hits = deque(r[0] for r in self.hits.get())
        for row in sorted(rows, key=lambda r: (r["_t"], r[self.order])):
            allowed, wait = admit(hits, row["_t"], self.limit, self.window)
            yield Row(**{self.key: key[0], self.order: row[self.order], "allowed": allowed, "retry_after": wait})
        if hits:
            self.hits.put([(t,) for t in hits])
        else:
            self.hits.clear()

    def close(self) -> None:
        pass


def admit_stream(events: DataFrame, key: str, ts: str, order: str, limit: int = LIMIT,
                 window_seconds: float = WINDOW, idle_seconds: float | None = None) -> DataFrame:
    """Streaming form: state per key is the list of the times of its last admitted events, at most `limit`.

    The events of one trigger are decided in the order of ts, then `order`; across
    triggers the order of arrival counts. The source's limit per trigger bounds
    what a key can bring at once. Every event gets a decision, however late it
    is: there is no watermark that could take it away. With `idle_seconds` the
    state of a key that brings nothing for so long (by the clock, so choose more
    than the window and the greatest delay together) lapses; without it state
    stays. State that lapses by the clock needs a trigger that goes on, as an
    available-now run would not end. Start the query inside `session.state_on_disk`.
    """
    window = round(window_seconds * 1e6)
    out_schema = T.StructType([
        T.StructField(key, events.schema[key].dataType), T.StructField(order, events.schema[order].dataType),
        T.StructField("allowed", T.BooleanType()), T.StructField("retry_after", T.DoubleType()),
    ])
    timed = events.select(key, order, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    processor = _Log(key, order, limit, window, round(idle_seconds * 1000) if idle_seconds else None)
    return timed.groupBy(key).transformWithState(processor, out_schema, "append", "processingTime" if idle_seconds else "none")
