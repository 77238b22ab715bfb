"""Loads that write only the buckets of the stored tables and of the index that their names touch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairlight.operators import resolve
from pairlight.plans import ingest as plan
from pairlight.session import cut, scratch
from pairlight.sources import tables
from pairlight.sources.buckets import BucketTable

#: Row id and bucket column of each stored table.
LAYOUT = {
    "drugs": ("drug_id", "rxcui"), "drug_synonyms": ("drug_id", "drug_id"), "labels": ("label_id", "label_id"),
    "label_sections": ("section_id", "label_id"), "drug_label_links": ("link_id", "drug_id"), "chunk_index": ("chunk_id", "rxcui"),
}


@dataclass(frozen=True)
class BucketStore:
    """The stored tables and the chunk index in one folder; a version counts once its mark stands in `commits`."""

    spark: SparkSession
    folder: str
    buckets: int = 64

    def table(self, name: str) -> BucketTable:
        return BucketTable(self.spark, f"{self.folder}/{name}", tables.SCHEMAS[name], *LAYOUT[name], self.buckets)

    def latest(self) -> int | None:
        return tables.latest(self.spark, self.folder)

    def read(self, name: str, version: int | None, buckets: list[int] | None = None) -> DataFrame:
        return tables.empty(self.spark, name) if version is None else self.table(name).read(version, buckets)

    def load_batch(self, names: DataFrame, batch_id: int, sources: plan.Sources, embedder, run: str = "stream") -> int:
        """The version after the last complete one, from it and the names not yet known; returns its number.

        The rows that the names bring say which buckets of each table are touched. Those are read, merged and written
        anew; the manifests carry all other buckets' files over. A batch that is run again finds its mark and changes
        nothing; one that broke off is done again, onto the last complete version.
        """
        done = tables.commits(self.spark, self.folder).where((F.col("run") == run) & (F.col("batch_id") == batch_id)).first()
        if done is not None:
            return done["version"]
        with scratch(self.spark):
            return self._next_version(names, batch_id, sources, embedder, run)

    def _next_version(self, names: DataFrame, batch_id: int, sources: plan.Sources, embedder, run: str) -> int:
        before = self.latest()
        version = 0 if before is None else before + 1
        unknown = resolve.unknown_names(names, self.read("drugs", before), self.read("drug_synonyms", before))
        as_of = F.current_timestamp()
        new = plan.prepare(cut(names.join(unknown, "name", "left_semi")), sources, as_of)
        brought = {"drugs": new.drugs, "drug_synonyms": new.drugs, "labels": new.labels, "label_sections": new.labels, "drug_label_links": new.drugs}
        touched = {name: self.table(name).touched(rows) for name, rows in brought.items()}
        old = plan.Store(*[self.read(f.name, before, touched[f.name]) for f in fields(plan.Store)])
        after, report = plan.merge(new, old, as_of)
        report.write.mode("overwrite").parquet(f"{self.folder}/reports/version={version}")
        for f in fields(plan.Store):
            self.table(f.name).rewrite(tables.conform(getattr(after, f.name), f.name), touched[f.name], before, version)
        after = plan.Store(*[self.read(f.name, version, touched[f.name]) for f in fields(plan.Store)])
        index = touched["drugs"]
        rows, counts = plan.build_index(after, self.read("chunk_index", before, index), embedder, new.drugs.select("rxcui"))
        self.table("chunk_index").rewrite(tables.conform(rows, "chunk_index"), index, before, version)
        counts.write.mode("overwrite").parquet(f"{self.folder}/index_reports/version={version}")
        tables.commit(self.spark, self.folder, run, batch_id, version)
        return version


def start(names: DataFrame, store: BucketStore, checkpoint: str, sources: Callable[[], plan.Sources], embedder) -> StreamingQuery:
    """Load names until the source is used up; each batch writes one version. The checkpoint names the run."""
    def run(batch: DataFrame, batch_id: int) -> None:
        store.load_batch(batch, batch_id, sources(), embedder, run=checkpoint)

    return names.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
