"""Knowledge-base tables and the chunk index as Parquet snapshots."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Stored tables.
SCHEMAS = {
    "drugs": "drug_id bigint, rxcui string, normalized_name string, term_type string, generic_name string, "
             "input_name string, match_type string, match_score double, source string, source_url string, "
             "created_at timestamp, updated_at timestamp",
    "drug_synonyms": "drug_id bigint, synonym string, synonym_type string, ord int",
    "labels": "label_id bigint, setid string, spl_version string, title string, manufacturer string, "
              "published_date string, source_url string, api_url string, retrieved_at timestamp, updated_at timestamp",
    "label_sections": "section_id bigint, label_id bigint, section_key string, section_code string, "
                      "section_name string, text string, found boolean, updated_at timestamp",
    "drug_label_links": "link_id bigint, drug_id bigint, label_id bigint, evidence_status string, "
                        "candidates_checked int, total_candidates_found int, retrieved_at timestamp",
    "chunk_index": "chunk_id string, text string, embedding array<double>, drug_name string, rxcui string, "
                   "label_setid string, spl_version string, manufacturer string, section_key string, "
                   "section_name string, section_code string, source_url string, api_url string, "
                   "db_record_id bigint, link_id bigint, evidence_status string, chunk_index int, total_chunks int",
}


def natural_id(*columns: str):
    """Surrogate id that every run and every task computes alike from the natural key."""
    return F.xxhash64(*[F.col(c) for c in columns])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select the columns of a stored table in their types; missing nullable columns become null."""
    have = set(df.columns)
    fields = [f.strip().split(" ", 1) for f in SCHEMAS[table].split(", ")]
    return df.select(*[
        (F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in fields
    ])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def write_snapshot(df: DataFrame, folder: str, table: str, version: int) -> str:
    """Write a whole table to the folder of its version; readers of older versions are not disturbed.

    A task or a batch that is run again replaces its own version only.
    """
    path = f"{folder}/{table}/version={version}"
    conform(df, table).write.mode("overwrite").parquet(path)
    return path


def read_snapshot(spark: SparkSession, folder: str, table: str, version: int) -> DataFrame:
    return conform(spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}/version={version}"), table)


def save_bucketed(df: DataFrame, path: str, id: str, buckets: int) -> DataFrame:
    """Write df in buckets of `id`, sorted by it within a bucket, and read it back as a table that Spark knows to be so.

    Joins and groups on `id` then read the buckets as they are. The catalog's entry is
    needed to plan the read only and is dropped again; the files stay in `path`.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    session = df.sparkSession
    df.repartition(buckets, id).write.bucketBy(buckets, id).sortBy(id).option("path", path).format("parquet").saveAsTable(name)
    read = session.table(name)
    read.schema  # analysed before the entry goes
    session.sql(f"DROP TABLE {name}")
    return read


COMMITS = "run string, batch_id bigint, version bigint"


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """(run, batch_id, version) of every version that is complete; none for a new folder."""
    found = read_or_none(spark, f"{folder}/commits", COMMITS)
    return spark.createDataFrame([], COMMITS) if found is None else found


def read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest(spark: SparkSession, folder: str) -> int | None:
    return commits(spark, folder).agg(F.max("version")).first()[0]


def commit(spark: SparkSession, folder: str, run: str, batch_id: int, version: int) -> None:
    """Mark a version as complete, after all its tables are written."""
    spark.createDataFrame([(run, batch_id, version)], COMMITS).coalesce(1).write.mode("append").parquet(f"{folder}/commits")


def by_ids(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def without_ids(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("chunk_id"), "chunk_id", "left_anti")


def put_chunks(index: DataFrame, new: DataFrame) -> DataFrame:
    """Index after replacing or adding the given chunks by id."""
    return without_ids(index, new).unionByName(new.select(*index.columns))
