"""How text filters interact, counted by an incremental stream with retractions.

All files of a table pass through available-now micro-batches. A document's
mask has a bit per filter that it fails. Four filters look at the text alone;
the fifth, a smaller id with the same text, can come true later, so the smallest
id of each text is kept as state. A batch brings additions to the counters of
(part, mask, quality, toxicity); when a smaller id arrives, the mask counted for
the one before is taken back and counted again with the bit of a copy. Counters
are written per batch under its number, so a batch that runs again replaces its
own rows only. All orders of the filters are then read off the counters.

Copies inside a stretch of rows are settled before the shuffle: only a
stretch's smallest id of each text goes to the state. State is kept in buckets
of about BUCKET texts by digest, which spares the cost of a call per text; a
bucket that a batch brings nothing for isn't touched.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pairlight.llm.chunks import short_batches
from pairlight.session import work_folder

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
BUCKET, BATCHES, STRETCH = 64, 4, 1 << 16
_ODD = re.compile(rb"[#$%&*|]")
_UPPER = bytes(range(0x41, 0x5B))
COUNTER = "part string, mask int, good boolean, toxic boolean, n bigint"
#: State of any size stays off the heap, a batch adds what it changed to the checkpoint in place of a whole copy, and small stores reserve no disk.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
         "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def text_mask(data: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails; words end at ASCII white space."""
    words = data.split()
    points = len(data) if data.isascii() else len(data.decode())
    capitals = len(data) - len(data.translate(None, _UPPER))
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * capitals > 5 * points) << 2 | bool(_ODD.search(data)) << 3


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in short_batches(batches):
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), pa.array([sha256(t).digest() for t in texts], pa.binary()), pa.array([text_mask(t) for t in texts], pa.int32())],
            names=["doc_id", "part", "digest", "mask"])


def settle(rows: list[tuple], kept: dict[bytes, tuple]) -> dict[tuple, int]:
    """Changes of the counters (part, mask, good, toxic) that `rows` bring, and the new state of their texts in `kept`.

    A row is (digest, doc_id, mask, part, good, toxic, n), `kept` has (doc_id, mask, {(part, good, toxic): n}) for each
    text's smallest id. Rows with that very id are no copies of each other. Null ids are neither copies nor originals.
    """
    change: dict[tuple, int] = {}

    def add(mask: int, of: dict[tuple, int], sign: int = 1) -> None:
        for (part, good, toxic), n in of.items():
            key = (part, mask, good, toxic)
            change[key] = change.get(key, 0) + sign * n

    for digest, doc_id, mask, part, good, toxic, n in rows:
        here = {(part, good, toxic): n}
        if mask & COPY or doc_id is None:  # settled before, or never
            add(mask, here)
            continue
        least = kept.get(digest)
        if least is None or doc_id < least[0]:
            if least is not None:
                add(mask, least[2], -1)
                add(mask | COPY, least[2])
            kept[digest] = (doc_id, mask, here)
            add(mask, here)
        elif doc_id == least[0]:
            least[2][part, good, toxic] = least[2].get((part, good, toxic), 0) + n
            add(mask, here)
        else:
            add(mask | COPY, here)
    return {k: n for k, n in change.items() if n}


def _combined(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of the state's input: the smallest id of each text in a stretch, and counts of its copies there."""
    names = ["bucket", "digest", "doc_id", "mask", "part", "good", "toxic", "n"]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.int64()]

    def combine(rows: list[tuple]) -> pa.RecordBatch:
        kept: dict[bytes, tuple] = {}
        change = settle(rows, kept)
        out = []
        for digest, (doc_id, mask, of) in kept.items():
            for (part, good, toxic), n in of.items():
                out.append((digest, doc_id, mask, part, good, toxic, n))
                change[part, mask, good, toxic] -= n  # the state will count it
        sure = [(sha256(repr(k).encode()).digest(), None, k[1], k[0], k[2], k[3], n) for k, n in change.items() if n]
        rows = [(int.from_bytes(r[0][:7], "big") % buckets, *r) for r in out + sure]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types, strict=True)], names=names)

    held: list[tuple] = []
    for batch in batches:
        held += [(d, i, m, p, g, t, 1) for d, i, m, p, g, t in zip(*(batch.column(c).to_pylist() for c in ("digest", "doc_id", "mask", "part", "good", "toxic")), strict=True)]
        if len(held) >= STRETCH:
            yield combine(held)
            held = []
    yield combine(held)


class _Least(StatefulProcessor):
    """The smallest id of each text of a bucket."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("least", "kept binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.state.get()
        kept = pickle.loads(old[0]) if old else {}
        change = settle([tuple(r[c] for c in ("digest", "doc_id", "mask", "part", "good", "toxic", "n")) for r in rows], kept)
        if kept:
            self.state.update((pickle.dumps(kept),))
        for (part, mask, good, toxic), n in change.items():
            yield Row(part=part, mask=mask, good=good, toxic=toxic, n=n)

    def close(self) -> None:
        pass


def _listed(spark: SparkSession, path: str) -> str:
    """A pattern for a single file, which a stream takes in place of a folder; other paths stay."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile()
    return f"{path[:-1]}[{path[-1]}]" if single else path


def _files_size(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def count_masks(spark: SparkSession, path: str, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", batches: int = BATCHES, files: int | None = None) -> DataFrame:
    """(part, mask, good, toxic, n) of the Parquet table at `path`, streamed in about `batches` batches (or `files` files each).

    `labels` has doc_id, quality and toxic; of several rows with one id the largest values count, ids without a label
    are neither good nor toxic. Null texts are empty, null parts the empty string. Other columns take no part.
    """
    given = spark.read.parquet(path)
    folder = f"{work_folder(spark)}/masks-{uuid.uuid4().hex}"
    known = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    known.write.parquet(f"{folder}/labels")
    known = spark.read.schema(known.schema).parquet(f"{folder}/labels")
    buckets = max(1, given.count() // BUCKET)  # from the files' footers
    # Old files count as well: by default a stream passes over files much older than the newest one.
    source = spark.readStream.schema(given.schema).option("maxFileAge", "36500d")
    source = source.option("maxFilesPerTrigger", files) if files else source.option("maxBytesPerTrigger", max(1, -(-_files_size(given) // batches)))
    rows = source.parquet(_listed(spark, path)).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    marked = rows.mapInArrow(_masked, "doc_id bigint, part string, digest binary, mask int").join(known, "doc_id", "left").select(
        "digest", "doc_id", "mask", "part", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    combined = marked.mapInArrow(lambda b: _combined(b, buckets), "bucket bigint, digest binary, doc_id bigint, " + COUNTER.replace("part string, mask int", "mask int, part string"))
    changes = combined.groupBy("bucket").transformWithState(_Least(), COUNTER, "update", "none")

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        changes.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/stream").foreachBatch(add).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not given.head(1):
        return spark.createDataFrame([], COUNTER)
    counters = spark.read.schema(f"{COUNTER}, batch int").parquet(f"{folder}/counters")
    return counters.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")


def interactions(counters: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    What fails no filter of a set is summed up for each of the 32 sets once per part; every figure is a difference of those sums.
    """
    every = (1 << len(FILTERS)) - 1
    free = lambda s, only: F.coalesce(F.sum(F.when((F.col("mask").bitwiseAND(F.lit(s)) == 0) & only, F.col("n"))), F.lit(0)).cast("bigint")
    sums = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    per = counters.groupBy("part").agg(*[F.array(*[free(s, only) for s in range(every + 1)]).alias(f"free_{name}") for name, only in sums.items()])
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for i, f in enumerate(order):
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(before).alias("before"), F.lit(1 << FILTERS.index(f)).alias("own")))
            before |= 1 << FILTERS.index(f)
    at = lambda name, s: F.col(f"free_{name}")[s]
    before, own = F.col("s.before"), F.col("s.own")
    lost = lambda name: at(name, before) - at(name, before.bitwiseOR(own))

    def shapley(f: int) -> Column:
        bit, total = 1 << f, F.lit(0).cast("bigint")
        for s in range(every + 1):
            if not s & bit:
                k = s.bit_count()
                total = total + F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) * (at("all", F.lit(s)) - at("all", F.lit(s | bit)))
        return total

    valued = per.withColumn("values", F.array(*[shapley(f) for f in range(len(FILTERS))]))
    made = valued.withColumn("s", F.explode(F.array(*steps)))
    fails = at("all", F.lit(0)) - at("all", own)
    which = F.log2(own.cast("double")).cast("int")
    return made.select("part", "s.filter_order", F.col("s.step").cast("int").alias("step"), at("all", before.bitwiseOR(own)).alias("kept"), lost("all").alias("removed"),
                       (fails - lost("all")).alias("redundant"), (at("all", F.lit(every).bitwiseXOR(own)) - at("all", F.lit(every))).alias("unique_fails"),
                       lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.col("values")[which].alias("shapley"))
