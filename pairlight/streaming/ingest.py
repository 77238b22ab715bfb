"""Names that arrive as files are loaded and indexed batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairlight.operators import resolve
from pairlight.plans import ingest as plan
from pairlight.session import cut, scratch
from pairlight.sources import tables


def read_names(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """(pos, name) from JSON lines."""
    return spark.readStream.schema("pos bigint, name string").option("maxFilesPerTrigger", files_per_trigger).json(folder)


def load_batch(spark: SparkSession, names: DataFrame, folder: str, batch_id: int, sources: plan.Sources, embedder, run: str = "stream") -> int:
    """The version after the last complete one, from it and the names not yet known; returns its number.

    A version counts once it is marked complete, with the run and batch that made
    it. A batch that is run again finds its mark and changes nothing; one that
    broke off is written again over its own incomplete version. So a stream can go
    on from a store that a load or another stream has written. What became of each
    name stands in reports/version=n, the index counts in index_reports/version=n.
    """
    done = tables.commits(spark, folder).where((F.col("run") == run) & (F.col("batch_id") == batch_id)).first()
    if done is not None:
        return done["version"]
    with scratch(spark):
        return _next_version(spark, names, folder, batch_id, sources, embedder, run)


def _next_version(spark: SparkSession, names: DataFrame, folder: str, batch_id: int, sources: plan.Sources, embedder, run: str) -> int:
    before = tables.latest(spark, folder)
    version = 0 if before is None else before + 1
    store = plan.Store.empty(spark) if before is None else plan.Store.read(spark, folder, before)
    index = None if before is None else tables.read_or_none(spark, f"{folder}/chunk_index/version={before}", tables.SCHEMAS["chunk_index"])
    unindexed = index is None
    index = tables.empty(spark, "chunk_index") if unindexed else index
    unknown = resolve.unknown_names(names, store.drugs, store.drug_synonyms)
    todo = cut(names.join(unknown, "name", "left_semi"))
    as_of = F.current_timestamp()
    after, report = plan.ingest(todo, store, sources, as_of)
    report.write.mode("overwrite").parquet(f"{folder}/reports/version={version}")
    after.write(folder, version, run=None)
    after = plan.Store.read(spark, folder, version)
    new_ids = after.drugs.join(store.drugs.select("rxcui"), "rxcui", "left_anti").select("rxcui")
    rows, counts = plan.build_index(after, index, embedder, None if unindexed else new_ids)
    tables.write_snapshot(rows, folder, "chunk_index", version)
    counts.write.mode("overwrite").parquet(f"{folder}/index_reports/version={version}")
    tables.commit(spark, folder, run, batch_id, version)
    return version


def start(names: DataFrame, folder: str, checkpoint: str, sources: Callable[[], plan.Sources], embedder) -> StreamingQuery:
    """Load names until the source is used up; each batch writes one version. The checkpoint names the run."""
    def run(batch: DataFrame, batch_id: int) -> None:
        load_batch(batch.sparkSession, batch, folder, batch_id, sources(), embedder, run=checkpoint)

    return names.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
