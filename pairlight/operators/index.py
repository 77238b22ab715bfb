"""Chunk index maintenance: diff, change-only embedding, stale deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlight.functions import text as tx

SECTION = ["link_id", "db_record_id"]


def index_diff(old: DataFrame, new: DataFrame, delete_unvisited: bool = False) -> DataFrame:
    """Chunk rows with status added, updated, unchanged or deleted; null for sections not visited.

    Only text decides between updated and unchanged. A chunk is deleted when its
    section was visited and no longer produces it. `delete_unvisited` also drops
    chunks of sections that the load did not visit at all. Rows of sections that
    the load does not visit take no part in the comparison: a small load moves
    only its own sections.
    """
    visited = new.select(*SECTION).distinct().withColumn("_v", F.lit(True))
    # Both sides are read once: old rows of sections not visited find no partner, since only visited ones have new rows.
    o = old.join(visited, SECTION, "left").withColumns({"_v": F.coalesce("_v", F.lit(False)), "_o": F.lit(True)}).alias("o")
    n = new.withColumns({"_v": F.lit(True), "_n": F.lit(True)}).alias("n")
    both = o.join(n, (F.col("o.chunk_id") == F.col("n.chunk_id")) & (F.col("o._v") == F.col("n._v")), "full_outer")
    is_new, is_old = F.col("n._n").isNotNull(), F.col("o._o").isNotNull()
    take_new = is_new & (~is_old | ~F.col("o.text").eqNullSafe(F.col("n.text")))
    return both.select(
        *[
            (F.when(take_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in new.columns
             else F.when(~take_new, F.col(f"o.{c}"))).alias(c)
            for c in old.columns
        ],
        F.when(is_new & ~is_old, "added").when(take_new, "updated").when(is_new, "unchanged").when(F.col("o._v"), "deleted")
        .otherwise(F.lit("deleted" if delete_unvisited else None).cast("string")).alias("status"),
    )


def embed_changes(diff: DataFrame, embedder, text: str = "text") -> DataFrame:
    """Index rows to store; vectors are computed for added and updated chunks only."""
    kept = diff.where(F.coalesce(F.col("status"), F.lit("")) != "deleted")
    changed = F.coalesce(F.col("status").isin("added", "updated"), F.lit(False))
    # Embedders pass over rows without text, so one pass serves changed and unchanged rows.
    asked = embedder(kept.withColumn("_t", F.when(changed, F.col(text))), "_t", "_e")
    return asked.withColumn("embedding", F.when(changed, F.col("_e")).otherwise(F.col("embedding"))).drop(
        "_t", "_e", "status"
    )


def index_report(diff: DataFrame, rejected: DataFrame, drugs: DataFrame, labels: DataFrame, sections: DataFrame, links: DataFrame) -> DataFrame:
    """One row of counts for a run over the given tables. Distinct drugs and sections are counted exactly.

    A drug is processed if it has a link to a label, a section if it has chunks;
    a section with text but without chunks is skipped as empty.
    """
    whole = links.join(drugs.select("drug_id", "rxcui"), "drug_id").join(labels.select("label_id"), "label_id", "left_semi").select("link_id", "label_id", "rxcui")
    texts = sections.where(F.col("found") & (tx.strip(F.coalesce("text", F.lit(""))) != "")).select("label_id", "section_id")
    linked = whole.agg(F.count_distinct("rxcui").alias("drugs_processed"))
    texted = texts.join(whole, "label_id").agg(F.count_distinct("link_id", "section_id").alias("_texts"))
    status = F.col("status")
    live = status.isin("added", "updated", "unchanged")
    counts = diff.agg(
        F.count_distinct(F.when(live, F.struct(*SECTION))).alias("sections_processed"),
        F.count_if(status == "added").alias("chunks_added"),
        F.count_if(status == "updated").alias("chunks_updated"),
        F.count_if(status == "unchanged").alias("chunks_unchanged"),
        F.count_if(status == "deleted").alias("chunks_deleted_stale"),
    )
    bad = rejected.agg(F.count("*").alias("malformed_records_skipped"))
    # One row each; added up, so that no join is needed.
    one = counts
    for more in (bad, linked, texted):
        one = one.unionByName(more, allowMissingColumns=True)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return one.agg(
        total("drugs_processed").alias("drugs_processed"), *[total(c).alias(c) for c in (*counts.columns, "malformed_records_skipped")],
        (total("_texts") - total("sections_processed")).alias("skipped_empty_sections"))
