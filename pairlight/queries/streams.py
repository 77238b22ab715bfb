"""Registered queries that run streams over given events until they are used up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pairlight.queries.registry import ADMIT, ORACLE, QUERIES, query
from pairlight.queries.roles import table
from pairlight.session import cut, state_on_disk, work_folder
from pairlight.streaming import admission as adm
from pairlight.streaming import audit


def _arriving(rows, part: str, parts: int, stream, mode: str = "append"):
    """Let `rows` arrive in turn, those with part = 0 first, and run the stream that `stream` makes of them after each; what it wrote."""
    spark, folder = rows.sparkSession, f"{work_folder(rows.sparkSession)}/stream-{uuid.uuid4().hex}"
    rows = cut(rows)
    schema = rows.drop(part).schema
    for k in range(parts):
        rows.where(F.col(part) == k).drop(part).write.mode("append").parquet(f"{folder}/in")
        with state_on_disk(spark):
            made = stream(spark.readStream.schema(schema).option("maxFileAge", "36500d").parquet(f"{folder}/in"))
            made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/seen").outputMode(mode).trigger(
                availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{folder}/out")


def admission_stream(spark, sf):
    """Admission as a stream: four parts of the time line arrive in turn, and each run goes on from the state of the one before."""
    events = table(spark, sf, "events").select("user_id", "event_id", "ts")
    times = F.unix_micros(F.col("ts").cast("timestamp"))
    span = events.agg(F.min(times).alias("low"), F.max(times).alias("high")).first()
    width = max(1, -(-((span["high"] or 0) - (span["low"] or 0) + 1) // 4))
    dealt = events.withColumn("part", F.floor((times - F.lit(span["low"] or 0)) / F.lit(width)))
    out = _arriving(dealt, "part", 4, lambda s: adm.admit_stream(s, "user_id", "ts", "event_id", ADMIT[0], ADMIT[1]))
    return out.select("user_id", "event_id", "allowed", F.round("retry_after", 3).alias("retry_after"))


QUERIES["admission_stream"] = admission_stream
ORACLE["admission_stream"] = ORACLE["admission"]

#: Six-hour windows; every fiftieth event comes two parts late.
WIDTH, LATENESS = 21600, "1 day"


@query(f"""WITH e AS (SELECT ts, event_type AS endpoint, user_id % 3 AS m, value, time_bucket(INTERVAL '{WIDTH} seconds', ts, TIMESTAMP '1970-01-01') AS w,
      least(3, event_id * 4 // (SELECT max(event_id) + 1 FROM events) + CASE WHEN event_id % 50 = 0 THEN 2 ELSE 0 END) AS part FROM events),
    marks AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL '{LATENESS}' AS mark FROM e GROUP BY 1),
    f AS (SELECT *, coalesce(w + INTERVAL '{WIDTH} seconds' <= mark, false) AS late, w + INTERVAL '{WIDTH} seconds' <= (SELECT max(ts) FROM e) - INTERVAL '{LATENESS}' AS closed FROM e JOIN marks USING (part))
    SELECT w AS window_start, endpoint, 'status ' || m AS evidence_status, 'evidence_only' AS llm_mode, count(*) FILTER (NOT late) AS n_requests,
      round(coalesce(sum(value) FILTER (NOT late), 0), 2) AS sum_latency, count(*) FILTER (late) AS n_late FROM f WHERE closed GROUP BY ALL""")
def audit_windows(spark, sf):
    """Counts of closed windows with the rows that came too late for them beside; a window that has not closed is not out yet."""
    part = F.least(F.lit(3), F.floor(F.col("event_id") * 4 / F.col("n")) + F.when(F.col("event_id") % 50 == 0, 2).otherwise(0))
    events = table(spark, sf, "events")
    n = events.agg(F.max("event_id") + 1).first()[0] or 1
    checks = events.withColumn("n", F.lit(n)).select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("endpoint"), F.concat(F.lit("status "), F.col("user_id") % 3).alias("evidence_status"),
        F.lit("evidence_only").alias("llm_mode"), F.col("value").alias("latency_ms"), part.alias("part"))
    out = _arriving(checks, "part", 4, lambda s: audit.windows_with_late(s, WIDTH, LATENESS))
    return out.groupBy(*audit.GROUP).agg(F.sum("n_requests").alias("n_requests"), F.round(F.sum("sum_latency"), 2).alias("sum_latency"), F.sum("n_late").alias("n_late"))
