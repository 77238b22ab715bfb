"""Sections to chunks with provenance, and the records that cannot be chunked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlight import vocab
from pairlight.functions import text as tx


def chunk_texts(
    df: DataFrame, text: str = "text", size: int = vocab.CHUNK_WORDS, overlap: int = vocab.CHUNK_OVERLAP,
    min_chars: int = vocab.CHUNK_MIN_CHARS,
) -> DataFrame:
    """One row per window of each text: chunk_index, chunk_text, word_count, total_chunks."""
    windows = df.withColumn("_w", tx.chunk_windows(F.col(text), size, overlap, min_chars))
    keep = [F.col(c) for c in df.columns if c != text]
    return (
        windows.select(*keep, F.size("_w").alias("total_chunks"), F.posexplode("_w").alias("chunk_index", "chunk_text"))
        .withColumn("word_count", F.size(F.split("chunk_text", " ")))
    )


def evidence_rows(drugs: DataFrame, labels: DataFrame, sections: DataFrame, links: DataFrame) -> DataFrame:
    """Sections joined to their label, link and drug; links without drug or label fall out."""
    return (
        sections.join(labels, "label_id")
        .join(links, "label_id")
        .join(drugs, "drug_id")
    )


def priority(section_key) -> F.Column:
    """Sort keys for sections: listed keys first, then the others by name."""
    order = F.array(*[F.lit(k) for k in vocab.SECTION_PRIORITY])
    return F.coalesce(F.nullif(F.array_position(order, section_key), F.lit(0)), F.lit(len(vocab.SECTION_PRIORITY) + 1))


def build_chunks(
    drugs: DataFrame, labels: DataFrame, sections: DataFrame, links: DataFrame,
    size: int = vocab.CHUNK_WORDS, overlap: int = vocab.CHUNK_OVERLAP,
) -> DataFrame:
    """Chunks of every found section with the provenance columns of the index.

    The section text is chunked after the joins on ids, in one narrow stage, so
    the windows themselves are never shuffled.
    """
    usable = sections.where(F.col("found") & (tx.strip(F.coalesce("text", F.lit(""))) != ""))
    rows = evidence_rows(drugs, labels, usable, links).select(
        "link_id",
        F.col("section_id").alias("db_record_id"),
        F.col("normalized_name").alias("drug_name"),
        "rxcui",
        F.col("setid").alias("label_setid"),
        "spl_version",
        "manufacturer",
        "section_key",
        "section_name",
        "section_code",
        F.col("source_url"),
        F.col("api_url"),
        "evidence_status",
        "text",
    )
    return chunk_texts(rows, "text", size, overlap).select(
        F.concat(
            F.lit("link-"), F.col("link_id"), F.lit("-section-"), F.col("db_record_id"), F.lit("-chunk-"),
            F.col("chunk_index"),
        ).alias("chunk_id"),
        F.col("chunk_text").alias("text"),
        *[c for c in rows.columns if c != "text"],
        "chunk_index",
        "total_chunks",
    )


def rejects(drugs: DataFrame, labels: DataFrame, sections: DataFrame, links: DataFrame) -> DataFrame:
    """Records counted as malformed: links without drug or label, found sections without text."""
    whole = links.join(drugs.select("drug_id"), "drug_id", "left_semi").join(
        labels.select("label_id"), "label_id", "left_semi"
    )
    orphans = links.join(whole.select("link_id"), "link_id", "left_anti").select(
        F.lit("link").alias("kind"), F.col("link_id").alias("record_id"), F.lit("missing drug or label").alias("reason")
    )
    blank = (
        sections.where(F.col("found") & (tx.strip(F.coalesce("text", F.lit(""))) == ""))
        .join(whole.select("label_id").distinct(), "label_id", "left_semi")
        .select(
            F.lit("section").alias("kind"), F.col("section_id").alias("record_id"),
            F.lit("found without text").alias("reason"),
        )
    )
    return orphans.unionByName(blank)


def sections_for_drug(
    drugs: DataFrame, labels: DataFrame, sections: DataFrame, links: DataFrame,
    rxcui: str | None = None, section_key: str | None = None, only_found: bool = False,
) -> DataFrame:
    """Stored sections of a drug (or of all drugs), by key and found flag if given."""
    if rxcui is not None:
        drugs = drugs.where(F.col("rxcui") == rxcui)
    if section_key is not None:
        sections = sections.where(F.col("section_key") == section_key)
    if only_found:
        sections = sections.where("found")
    return evidence_rows(drugs.select("drug_id", "rxcui"), labels.select("label_id", "setid"), sections,
                         links.select("link_id", "drug_id", "label_id"))
