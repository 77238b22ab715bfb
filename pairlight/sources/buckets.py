"""A table in hash buckets of files, with a manifest per version.

A row belongs to the bucket of its `by` column. A version's manifest names the
file sets of every bucket; a change writes file sets for the buckets that it
touches only and a manifest that carries all others over as they are. A file set
is `base` (whole rows of a bucket), `put` (rows that replace or join those with
their id) or `gone` (ids that are taken away); later sets count over earlier
ones, merged when read. Writing a bucket anew ends its list. The manifest is
written last: what broke off before it does not exist, and a change that runs
again under its number writes the same folders again.

The driver holds manifests, whose size is that of the bucket count, and no rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.sources.tables import read_or_none

MANIFEST = "bucket int, kind string, seq bigint, folder string"
BUCKETS = 64


@dataclass(frozen=True)
class BucketTable:
    """Rows of `schema` in `folder`, told apart by `id`, kept in buckets of `by`."""

    spark: SparkSession
    folder: str
    schema: str
    id: str
    by: str
    buckets: int = BUCKETS

    def bucket_of(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")

    # Versions ------------------------------------------------------------------

    def version(self) -> int | None:
        """The latest complete version; a version's manifest folder is complete with its mark."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(place):
            return None
        found = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(place)
                 if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return max(found, default=None)

    def manifest(self, version: int | None = None) -> list[dict]:
        """File sets (bucket, kind, seq, folder) of a version, the latest by default; none for a new table."""
        version = self.version() if version is None else version
        if version is None:
            return []
        found = read_or_none(self.spark, f"{self.folder}/manifest/version={version}", MANIFEST)
        return sorted((r.asDict() for r in found.collect()), key=lambda r: (r["bucket"], r["seq"], r["kind"])) if found else []

    def _commit(self, sets: list[dict], version: int) -> int:
        rows = [(s["bucket"], s["kind"], s["seq"], s["folder"]) for s in sets]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")
        return version

    def _write(self, rows: DataFrame, kind: str, version: int) -> list[dict]:
        """File sets of one change, one per bucket that has rows. Small buckets are written by one task, large ones by several."""
        path = f"{self.folder}/data/{version}-{kind}"
        (rows.withColumn("_bucket", self.bucket_of(F.col(self.by))).hint("rebalance", F.col("_bucket")).sortWithinPartitions("_bucket", self.id)
         .write.mode("overwrite").partitionBy("_bucket").parquet(path))
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        listed = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(place)
        names = sorted(f.getPath().getName() for f in listed if f.isDirectory())
        return [{"bucket": int(n.split("=")[1]), "kind": kind, "seq": version, "folder": f"data/{version}-{kind}/{n}"} for n in names]

    # Changes -------------------------------------------------------------------

    def put(self, rows: DataFrame) -> int:
        """Add rows, or replace those with their ids; a row's bucket must not change. Returns the new version."""
        return self._add(rows, "put")

    def delete(self, ids: DataFrame) -> int:
        """Take away the rows of `ids` (id, by). Ids that are not there change nothing."""
        return self._add(ids.select(self.id, self.by), "gone")

    def _next(self) -> tuple[int | None, int]:
        now = self.version()
        return now, 0 if now is None else now + 1

    def _add(self, rows: DataFrame, kind: str) -> int:
        now, version = self._next()
        return self._commit(self.manifest(now) + self._write(rows, kind, version), version)

    def rewrite(self, rows: DataFrame, buckets: list[int], onto: int | None = None, version: int | None = None) -> int:
        """Replace whole buckets by `rows`; rows of other buckets are an error. Other buckets keep their files.

        `onto` and `version` name the version that is changed and the new one; by default the latest and the next.
        """
        if version is None:
            onto, version = self._next()
        kept = [] if onto is None else [s for s in self.manifest(onto) if s["bucket"] not in set(buckets)]
        if not buckets:
            return self._commit(kept, version)
        strange = F.raise_error(F.lit("a row of a bucket that is not written")).cast("boolean")
        checked = rows.where(F.when(self.bucket_of(F.col(self.by)).isin(buckets), True).otherwise(strange))
        return self._commit(kept + self._write(checked, "base", version), version)

    def compact(self, buckets: list[int] | None = None) -> int | None:
        """Write buckets with more than one file set anew, all of them by default."""
        sets = self.manifest()
        many = {b for b in (s["bucket"] for s in sets) if sum(s["bucket"] == b for s in sets) > 1 or any(s["bucket"] == b and s["kind"] != "base" for s in sets)}
        chosen = sorted(many if buckets is None else many & set(buckets))
        return self.rewrite(self.read(buckets=chosen), chosen) if chosen else self.version()

    # Reads ---------------------------------------------------------------------

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of a table of `by` values: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in keys.select(self.bucket_of(F.col(self.by))).distinct().collect())

    def read(self, version: int | None = None, buckets: list[int] | None = None, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
        """Rows of a version, of some buckets or of all. Only file sets of those buckets are opened.

        A bucket of one base set is read as it is. Others are merged: of each id the row of the latest set counts.
        With `where` and `columns`, those rows of the version and columns only. A row that `where` leaves out takes part
        in the merge by its id alone, as its older forms must not count, so little more than what is asked for is moved.
        """
        sets = [s for s in self.manifest(version) if buckets is None or s["bucket"] in set(buckets)]
        layers: dict[int, set[str]] = {}
        for s in sets:
            layers.setdefault(s["bucket"], set()).add(s["kind"])
        plain = [s for s in sets if layers[s["bucket"]] == {"base"}]
        merged = [s for s in sets if layers[s["bucket"]] != {"base"}]
        empty = self.spark.createDataFrame([], self.schema)
        columns = columns or empty.columns
        asked = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        out = (self._open(plain) if plain else empty).where(asked).select(*columns)
        if merged:
            kinds = sorted({(s["seq"], s["kind"]) for s in merged})
            layered = None
            for seq, kind in kinds:
                part = self._open([s for s in merged if (s["seq"], s["kind"]) == (seq, kind)]).select(
                    F.col(self.id).alias("_id"), F.lit(seq).alias("_at"), F.when(F.lit(kind != "gone") & asked, F.struct(*columns)).alias("_r"))
                layered = part if layered is None else layered.unionByName(part)
            latest = layered.groupBy("_id").agg(F.max_by("_r", "_at").alias("_r")).where("_r is not null")
            newest = latest.select(*[F.col(f"_r.{c}").alias(c) for c in columns])
            out = newest if not plain else out.unionByName(newest)
        return out

    def _open(self, sets: list[dict]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{s['folder']}" for s in sets])

    def by_values(self, values: list, version: int | None = None, columns: list[str] | None = None) -> DataFrame:
        """Rows with one of the given `by` values, from their buckets alone."""
        kind = next(f.dataType for f in self.spark.createDataFrame([], self.schema).schema if f.name == self.by)
        keys = self.spark.createDataFrame([(v,) for v in values], f"{self.by} {kind.simpleString()}")
        return self.read(version, self.touched(keys), F.col(self.by).isin(values), columns)

    def describe(self, version: int | None = None) -> str:
        """The manifest as JSON lines, for people."""
        return "\n".join(json.dumps(s) for s in self.manifest(version))
