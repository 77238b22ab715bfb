"""Audit events: the fixed set of fields and counts over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fields kept per kind of event; anything else is dropped.
FIELDS = {
    "http_request": ("request_id", "method", "path", "status_code", "latency_ms", "client_host"),
    "interaction_check": ("request_id", "endpoint", "rxcui_a", "rxcui_b", "evidence_status", "llm_mode",
                          "latency_ms", "error_category"),
    "rate_limit_exceeded": ("request_id", "endpoint", "client_host"),
}


def audit_rows(df: DataFrame, event: str) -> DataFrame:
    """Only the fields of this kind of event, latency rounded to two decimals; absent fields are null."""
    have = set(df.columns)
    column = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    return df.select(
        "timestamp", F.lit(event).alias("event"),
        *[(F.round(column(c), 2) if c == "latency_ms" else column(c)).alias(c) for c in FIELDS[event]],
    )


def write_audit(df: DataFrame, event: str, path: str) -> None:
    """Append events as JSON lines."""
    audit_rows(df, event).write.mode("append").json(path)


def audit_rollup(df: DataFrame, by: list[str], latency: str = "latency_ms") -> DataFrame:
    """Requests per group with latency statistics. All aggregates combine on the map side."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_requests"),
        F.sum(latency).alias("sum_latency"),
        F.avg(latency).alias("avg_latency"),
        F.min(latency).alias("min_latency"),
        F.max(latency).alias("max_latency"),
        F.percentile_approx(latency, 0.5, 10000).alias("p50_latency"),
        F.percentile_approx(latency, 0.95, 10000).alias("p95_latency"),
    )
