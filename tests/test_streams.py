import datetime as dt
import random
from collections import deque

from pyspark.sql import functions as F

from pairlight.operators import audit
from pairlight.session import state_on_disk
from pairlight.streaming import admission, audit as audit_stream

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "key string, id bigint, ts timestamp"


def rows(times):
    return [(k, i, T0 + dt.timedelta(seconds=t)) for i, (k, t) in enumerate(times)]


def expected(times, limit, window):
    hits, out = {}, {}
    order = sorted(range(len(times)), key=lambda i: (times[i][1], i))
    for i in order:
        k, t = times[i]
        q = hits.setdefault(k, deque())
        while q and round((t - q[0]) * 1e6) > round(window * 1e6):
            q.popleft()
        out[i] = len(q) < limit
        if out[i]:
            q.append(t)
    return out


def test_small_log(spark):
    times = [("a", 0), ("a", 5), ("a", 10), ("a", 11), ("b", 5)]
    df = spark.createDataFrame(rows(times), SCHEMA)
    got = {r.id: (r.allowed, r.retry_after) for r in admission.admit_batch(df, "key", "ts", "id", 1, 10).collect()}
    assert got == {0: (True, 0.0), 1: (False, 5.0), 2: (False, 0.0), 3: (True, 0.0), 4: (True, 0.0)}


def test_refused_events_do_not_count(spark):
    times = [("a", t) for t in (0, 4, 8, 11, 14)]
    df = spark.createDataFrame(rows(times), SCHEMA)
    got = {r.id: r.allowed for r in admission.admit_batch(df, "key", "ts", "id", 1, 10).collect()}
    assert got == {0: True, 1: False, 2: False, 3: True, 4: False}


def test_segments_give_the_same_answers_as_one_pass(spark):
    rng = random.Random(7)
    for limit, window in ((3, 10.0), (5, 7.0), (1, 4.0)):
        times = []
        for k, n, span in (("hot", 400, 600), ("burst", 150, 90), ("calm", 60, 900)):
            times += [(k, round(rng.uniform(0, span), 1)) for _ in range(n)]
        df = spark.createDataFrame(rows(times), SCHEMA)
        got = {r.id: r.allowed for r in admission.admit_batch(df, "key", "ts", "id", limit, window).collect()}
        assert got == expected(times, limit, window)
        assert len(got) == len(times)


def test_a_hot_key_is_cut_into_segments(spark):
    times = [("hot", 5.0 * i) for i in range(300)]
    df = spark.createDataFrame(rows(times), SCHEMA).withColumn("_t", F.unix_micros("ts")).withColumn("_bucket", F.floor(F.col("_t") / 10_000_000))
    assert admission._with_segments(df, "key", 5, 10_000_000).select("_seg").distinct().count() > 50


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    times = sorted(((rng.choice("abc"), round(rng.uniform(0, 200), 1)) for _ in range(200)), key=lambda x: x[1])
    df = spark.createDataFrame(rows(times), SCHEMA)
    source = str(tmp_path / "in")
    df.where("id < 100").coalesce(1).write.parquet(source)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        with state_on_disk(spark):
            admission.admit_stream(stream, "key", "ts", "id", 3, 20.0).writeStream.format("parquet").option("path", out).option(
                "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    run()
    df.where("id >= 100").coalesce(1).write.mode("append").parquet(source)
    run()
    got = {r.id: r.allowed for r in spark.read.parquet(out).collect()}
    assert got == expected(times, 3, 20.0)


def test_late_rows_are_counted_beside_closed_windows(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    mark, seen, want = None, [], {}
    for times in ([0, 10, 70], [5, 130, 300, None], [20, 290, 310, 400, 65], [401, 0, 0]):
        rows = [(None if t is None else T0 + dt.timedelta(seconds=t), "e", "r", "/x", None, None, None if t == 5 else "s", "m", 1.5, None) for t in times]
        spark.createDataFrame(rows, audit_stream.CHECK_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        with state_on_disk(spark):
            audit_stream.windows_with_late(spark.readStream.schema(audit_stream.CHECK_SCHEMA).parquet(source), 60, "30 seconds").writeStream.format("parquet").option(
                "path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        for t in times:
            if t is not None:
                late = mark is not None and t // 60 * 60 + 60 <= mark
                key = (t // 60 * 60, None if t == 5 else "s")
                n, lates = want.get(key, (0, 0))
                want[key] = (n, lates + 1) if late else (n + 1, lates)
        seen += [t for t in times if t is not None]
        mark = max(seen) - 30
    got = {}
    for r in spark.read.parquet(out).collect():
        key = (int((r.window_start - T0).total_seconds()), r.evidence_status)
        n, lates = got.get(key, (0, 0))
        got[key] = (n + r.n_requests, lates + r.n_late)
    assert got == {k: v for k, v in want.items() if k[0] + 60 <= mark}
    assert sum(v[1] for v in got.values()) == 4


def test_audit_files_and_counts(spark, tmp_path):
    events = spark.createDataFrame(
        [(T0 + dt.timedelta(seconds=20 * i), f"r{i}", "/check", "1", "2", "supporting_evidence_found", "evidence_only", 1.2345, "secret") for i in range(9)],
        "timestamp timestamp, request_id string, endpoint string, rxcui_a string, rxcui_b string, evidence_status string, llm_mode string, latency_ms double, raw_name string")
    kept = audit.audit_rows(events, "interaction_check")
    assert "raw_name" not in kept.columns and kept.first().latency_ms == 1.23 and kept.first().error_category is None
    first = str(tmp_path / "first")
    audit.write_audit(events, "interaction_check", first)
    copied = str(tmp_path / "copied")
    audit_stream.sink(audit_stream.read_checks(spark, first), "interaction_check", copied, str(tmp_path / "cp1")).awaitTermination()
    assert spark.read.schema(audit_stream.CHECK_SCHEMA).json(copied).count() == 9
    counts = audit_stream.counts(audit_stream.read_checks(spark, copied), lateness="0 seconds")
    query = counts.writeStream.format("memory").queryName("audit_counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.window_start: r.n_requests for r in spark.table("audit_counts").collect()}
    assert got == {T0: 3, T0 + dt.timedelta(minutes=1): 3, T0 + dt.timedelta(minutes=2): 3}
    assert audit.audit_rollup(events, ["endpoint"]).first().n_requests == 9
