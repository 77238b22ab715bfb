"""Registered queries over bucketed tables: the chunk index and loads batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pairlight.operators import upsert
from pairlight.queries import oracle as o
from pairlight.queries import roles
from pairlight.queries.registry import AS_OF, LABEL_FIELDS, LOADED, ORACLE, QUERIES, load_names, load_sources, old_new_labels, query
from pairlight.session import cut, work_folder
from pairlight.sources import tables
from pairlight.sources.buckets import BucketTable
from pairlight.streaming import buckets as loads
from pairlight.streaming import ingest as stream


def label_upsert_stored(spark, sf):
    """label_upsert into the stored form: labels in buckets of their id, which the join reads without moving them."""
    named = lambda df: df.withColumn("label_id", tables.natural_id("setid", "spl_version"))
    old, new = (named(df) for df in old_new_labels(spark, sf))
    stored = tables.save_bucketed(old, f"{work_folder(spark)}/labels-{uuid.uuid4().hex}", "label_id", max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    diff = upsert.upsert_stored(stored, new, "label_id", ["setid", "spl_version"], LABEL_FIELDS, as_of=F.lit(AS_OF).cast("timestamp"))
    return diff.select("setid", "spl_version", "manufacturer", "status", "updated_at")


QUERIES["label_upsert_stored"] = label_upsert_stored
ORACLE["label_upsert_stored"] = ORACLE["label_upsert"]


def chunk_table(spark, buckets: int = 16) -> BucketTable:
    return BucketTable(spark, f"{work_folder(spark)}/index-{uuid.uuid4().hex}", tables.SCHEMAS["chunk_index"], *loads.LAYOUT["chunk_index"], buckets)


ASKED = ["1001", "1004", "1011"]


@query(f"""WITH i AS (SELECT chunk_id, rxcui, section_key, md5(CASE WHEN manufacturer = 'de' THEN 'new ' || text ELSE text END) AS text_hash FROM chunks WHERE section_key <> 'contraindications')
    SELECT 'ids' AS read_by, chunk_id, rxcui, text_hash FROM i WHERE rxcui IN {o.in_list(ASKED)}
    UNION ALL SELECT 'filter', chunk_id, rxcui, text_hash FROM i WHERE section_key = 'boxed_warning'
    UNION ALL SELECT 'first version', chunk_id, rxcui, md5(text) FROM chunks WHERE manufacturer <> 'es' AND section_key = 'boxed_warning'""")
def chunk_store(spark, sf):
    """The chunk index in buckets of drugs: put, put again with changed German and added Spanish chunks, deleted in part and
    compacted in part; read by ids and by a filter, and as it was first."""
    store = chunk_table(spark)
    rows = cut(roles.EMBEDDER(roles.chunks(spark, sf), "text", "embedding"))
    first = store.put(tables.conform(rows.where("manufacturer <> 'es'"), "chunk_index"))
    changed = rows.where("manufacturer IN ('de', 'es')").withColumn("text", F.when(F.col("manufacturer") == "de", F.concat(F.lit("new "), "text")).otherwise(F.col("text")))
    store.put(tables.conform(roles.EMBEDDER(changed, "text", "embedding"), "chunk_index"))
    store.delete(rows.where("section_key = 'contraindications'"))
    store.compact(list(range(0, store.buckets, 2)))
    out = lambda df, how: df.select(F.lit(how).alias("read_by"), "chunk_id", "rxcui", F.md5("text").alias("text_hash"))
    boxed, needed = F.col("section_key") == "boxed_warning", ["chunk_id", "rxcui", "text"]
    return (out(store.by_values(ASKED, columns=needed), "ids").unionByName(out(store.read(where=boxed, columns=needed), "filter"))
            .unionByName(out(store.read(first, where=boxed, columns=needed), "first version")))


@query(f"""WITH {LOADED},
    t AS (SELECT label_id, count(*) FILTER ({o.meaningful('raw')} OR k = 0) AS found, sum(CASE WHEN {o.meaningful('raw')} THEN {o.windows('raw', 180, 40)[0]} WHEN k = 0 THEN 1 ELSE 0 END) AS chunks FROM rawsections GROUP BY 1)
    SELECT rxcui, drug_id % 2 AS loaded_in, CASE WHEN labelled THEN 7 ELSE 0 END::BIGINT AS n_sections, CASE WHEN labelled THEN found ELSE 0 END::BIGINT AS n_found,
      CASE WHEN labelled THEN chunks ELSE 0 END::BIGINT AS n_chunks, true AS others_kept FROM r LEFT JOIN t ON t.label_id = r.first_doc WHERE known""")
def incremental_load(spark, sf):
    """Names that arrive in two batches of a stream: even drugs first, then odd ones and all that came before once more.

    loaded_in is the version that a drug is first in; others_kept says that the second version has, for every bucket of
    every table that its drugs do not touch, the files of the first.
    """
    store = loads.BucketStore(spark, f"{work_folder(spark)}/store-{uuid.uuid4().hex}", buckets=16)
    names, sources = cut(load_names(spark, sf)), load_sources(spark, sf)
    for part in (names.where("pos % 2 = 0"), names):
        part.write.mode("append").json(f"{store.folder}/names")
        loads.start(stream.read_names(spark, f"{store.folder}/names"), store, f"{store.folder}/names-seen", lambda: sources, roles.EMBEDDER).awaitTermination()
    first, last = 0, store.latest()
    drugs = store.read("drugs", last)
    own = drugs.join(store.read("drugs", first), "drug_id", "left_anti")  # what the second batch brought
    links = store.read("drug_label_links", last)
    labels = own.join(links, "drug_id").select("label_id")
    keys = {"drugs": own, "drug_synonyms": own, "drug_label_links": own, "chunk_index": own, "labels": labels, "label_sections": labels}
    kept = all(_untouched(store.table(t), first, last, k) for t, k in keys.items())
    sections = store.read("label_sections", last).join(links.select("label_id", "drug_id"), "label_id").groupBy("drug_id").agg(F.count("*").alias("n_sections"), F.count_if("found").alias("n_found"))
    chunks = store.read("chunk_index", last).groupBy("rxcui").agg(F.count("*").alias("n_chunks"))
    was = store.read("drugs", first).select("drug_id", F.lit(0).cast("long").alias("loaded_in"))
    zero = lambda c, d=0: F.coalesce(c, F.lit(d)).cast("long").alias(c)
    return drugs.select("drug_id", "rxcui").join(was, "drug_id", "left").join(sections, "drug_id", "left").join(chunks, "rxcui", "left").select(
        "rxcui", zero("loaded_in", last), zero("n_sections"), zero("n_found"), zero("n_chunks"), F.lit(kept).alias("others_kept"))


def _untouched(table: BucketTable, first: int, last: int, keys) -> bool:
    touched = set(table.touched(keys))
    of = lambda v: [s for s in table.manifest(v) if s["bucket"] not in touched]
    return of(first) == of(last)
