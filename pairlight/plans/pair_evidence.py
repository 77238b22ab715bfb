"""From names to ranked, classified evidence and one status per pair."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight import vocab
from pairlight.operators import mentions, pairs, resolve, search
from pairlight.session import cut


@dataclass(frozen=True)
class Knowledge:
    """Stored tables the retrieval reads.

    drugs:    drug_id, rxcui, normalized_name, generic_name, input_name
    synonyms: drug_id, synonym, synonym_type, ord
    classes:  class_term, ord, member
    index:    chunk_id, text, rxcui, embedding and provenance columns
    """

    drugs: DataFrame
    synonyms: DataFrame
    classes: DataFrame
    index: DataFrame

    @classmethod
    def of_store(cls, store, index: DataFrame) -> Knowledge:
        """What a load wrote (pairlight.plans.ingest.Store) with the index built from it and the fixed classes."""
        return cls(store.drugs, store.drug_synonyms, class_table(index.sparkSession), index)

    def terms(self) -> DataFrame:
        """(rxcui, term, ord): the normalized name, then the synonyms in stored order."""
        own = self.drugs.where(F.coalesce("normalized_name", F.lit("")) != "").select(
            "rxcui", F.col("normalized_name").alias("term"), F.lit(0).cast("long").alias("ord"))
        other = self.synonyms.where(F.col("synonym") != "").join(self.drugs.select("drug_id", "rxcui"), "drug_id").select(
            "rxcui", F.col("synonym").alias("term"), F.col("ord").cast("long").alias("ord"))
        return own.unionByName(other)


def class_table(spark: SparkSession) -> DataFrame:
    """The fixed class terms and their members."""
    rows = [(term, i, m) for i, (term, members) in enumerate(vocab.CLASS_TERMS.items()) for m in members]
    return spark.createDataFrame(rows, "class_term string, ord int, member string")


def resolve_pairs(asked: DataFrame, known: Knowledge) -> DataFrame:
    """Adds rxcui_a and rxcui_b to distinct (drug_a, drug_b), null where unknown.

    The distinct names are resolved once and written, since both sides join them.
    """
    distinct = cut(asked.select("drug_a", "drug_b").distinct())
    names = distinct.select(F.explode(F.array("drug_a", "drug_b")).alias("name"))
    ids = cut(resolve.resolve_drugs(names, known.drugs, known.synonyms.drop("ord")))
    return (
        distinct
        .join(ids.select(F.col("name").alias("drug_a"), F.col("rxcui").alias("rxcui_a")), "drug_a", "left")
        .join(ids.select(F.col("name").alias("drug_b"), F.col("rxcui").alias("rxcui_b")), "drug_b", "left")
    )


def searchable(resolved: DataFrame) -> DataFrame:
    """Distinct ordered pairs of two different known drugs."""
    return resolved.where(F.col("rxcui_a") != F.col("rxcui_b")).select("rxcui_a", "rxcui_b").distinct()


def evidence_for(pair_ids: DataFrame, known: Knowledge, embedder, k: int = vocab.TOP_K) -> DataFrame:
    """Ranked evidence rows of the given (rxcui_a, rxcui_b) pairs.

    Pairs that share a search share its result. The found (pair, chunk) rows are
    small, at most k rows for each of nine queries of a pair and without text.
    They, the texts of the found chunks and the terms found in them are written
    once each, because several branches read them.
    """
    terms = known.terms()
    queries = pairs.pair_queries(pair_ids, pairs.drug_cards(known.drugs, terms))
    asked = embedder(pairs.distinct_searches(queries), "query", "qvec")
    hits = search.top_k(
        asked.select(F.col("search_id").alias("query_id"), F.explode("scope").alias("scope"), "qvec"),
        known.index.select("chunk_id", F.col("rxcui").alias("scope"), F.col("embedding").alias("cvec")),
        k,
    ).withColumnRenamed("query_id", "search_id")
    items = cut(pairs.merge_hits(queries, hits))

    # Texts of the found chunks only; one pass over them looks for the terms of drugs and of classes.
    found = cut(known.index.drop("embedding").join(items.select("chunk_id").distinct(), "chunk_id", "left_semi"))
    every_term = terms.select("term").unionByName(known.classes.select(F.col("class_term").alias("term")))
    matched = cut(mentions.match_terms(found.select("chunk_id", "text"), every_term))
    per_drug = mentions.by_owner(matched, terms)
    per_class = mentions.by_class(matched, known.classes)
    names = known.drugs.select("rxcui", "normalized_name")
    # Rows are classified and ranked without texts; texts and provenance join the ranked rows.
    classified = pairs.classify(items.join(found.select("chunk_id", "rxcui"), "chunk_id"), per_drug, per_class, names)
    return pairs.rank_evidence(classified).join(found.drop("rxcui"), "chunk_id")


def statuses_for(resolved: DataFrame, evidence: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    return pairs.pair_status(resolved, pairs.pair_counts(evidence), failed)


def check_regimens(names: DataFrame, known: Knowledge, embedder, k: int = vocab.TOP_K) -> DataFrame:
    """Rows (regimen_id, pos, name) to one report row per accepted regimen.

    Regimens repeat the same pairs, so pairs are made distinct (with partial
    aggregation) before anything is resolved or searched. The pairs are written,
    since the report joins them again and the names need not be grouped twice.
    """
    asked = cut(pairs.regimen_pairs(pairs.check_regimens(names)))
    resolved = resolve_pairs(asked, known)
    statuses = statuses_for(resolved, evidence_for(searchable(resolved), known, embedder, k))
    return pairs.regimen_report(asked, statuses)


