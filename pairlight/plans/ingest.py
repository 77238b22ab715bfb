"""Load of drugs and labels for a table of names, and the index that follows from it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlight import vocab
from pairlight.operators import candidates as cd
from pairlight.operators import chunking, index, resolve, upsert
from pairlight.session import cut
from pairlight.sources import tables

DRUG_FIELDS = ["normalized_name", "term_type", "generic_name", "input_name", "match_type", "match_score", "source_url"]
LABEL_FIELDS = ["title", "manufacturer", "published_date", "source_url", "api_url"]
LINK_FIELDS = ["evidence_status", "candidates_checked", "total_candidates_found"]


@dataclass(frozen=True)
class Store:
    """The five stored tables, in the schemas of pairlight.sources.tables."""

    drugs: DataFrame
    drug_synonyms: DataFrame
    labels: DataFrame
    label_sections: DataFrame
    drug_label_links: DataFrame

    @classmethod
    def empty(cls, spark) -> Store:
        return cls(*[tables.empty(spark, f.name) for f in fields(cls)])

    @classmethod
    def read(cls, spark, folder: str, version: int) -> Store:
        return cls(*[tables.read_snapshot(spark, folder, f.name, version) for f in fields(cls)])

    def write(self, folder: str, version: int, run: str | None = "load") -> None:
        """Write all tables, then mark the version as complete; run None leaves the mark to the caller."""
        for f in fields(self):
            tables.write_snapshot(getattr(self, f.name), folder, f.name, version)
        if run is not None:
            tables.commit(self.drugs.sparkSession, folder, run, version, version)


@dataclass(frozen=True)
class Sources:
    """What a load reads.

    concepts:  rxcui, concept_name
    related:   rxcui, term_type, brand_names, generic_name, synonyms (one row per rxcui)
    found:     rxcui, rank, setid, spl_version, title, published_date (ranked label candidates)
    documents: output of sources.label_xml.parse_labels, doc being the candidate's setid; or a function that gives it for
               a table of wanted docs, so that only what a load looks at is parsed
    errors:    name, error (names whose lookup broke; None: no lookup did)
    """

    concepts: DataFrame
    related: DataFrame
    found: DataFrame
    documents: DataFrame | Callable[[DataFrame], DataFrame]
    errors: DataFrame | None = None


def first_value(*names: str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def choose_labels(found: DataFrame, documents: DataFrame) -> DataFrame:
    """One label per rxcui: the first of three candidates with interaction text, else the first.

    A candidate that cannot be read before a hit makes the lookup an error, with
    no label: something broken is never reported as nothing found.
    """
    wanted = F.exists("sections", lambda s: s["section_key"].isin(*vocab.INTERACTION_SECTIONS) & s["found"])
    docs = documents.select(
        F.col("doc").alias("setid"), F.coalesce(wanted, F.lit(False)).alias("hit"), F.lit(True).alias("_read"),
        "error", F.col("setid").alias("doc_setid"), F.col("spl_version").alias("doc_version"),
        F.col("title").alias("doc_title"), "manufacturer",
    )
    rows = found.join(docs, "setid", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    best = cd.best_candidate(rows, "rxcui", ["rank"], "hit")
    broken = (
        rows.where((F.col("rank") <= vocab.CANDIDATES_CHECKED) & (F.col("_read").isNull() | F.col("error").isNotNull()))
        .groupBy("rxcui").agg(F.min("rank").alias("_broken"))
    )
    return best.drop("_read", "error").join(broken, "rxcui", "left").withColumn(
        "evidence_status",
        F.when(F.col("_broken") < F.when(F.col("evidence_status") == "interaction_evidence_found", F.col("candidates_checked"))
               .otherwise(vocab.CANDIDATES_CHECKED + 1), "error").otherwise(F.col("evidence_status")),
    ).drop("_broken")


@dataclass(frozen=True)
class Incoming:
    """What the names of a load bring, before any stored table is looked at."""

    resolved: DataFrame
    drugs: DataFrame
    synonyms: DataFrame
    chosen: DataFrame
    usable: DataFrame
    labels: DataFrame
    sections: DataFrame
    links: DataFrame


def prepare(names: DataFrame, sources: Sources, as_of: Column) -> Incoming:
    """The rows that a load of (pos, name) brings. Several names may mean one drug; its row then comes from the last of them."""
    matched = resolve.match_vocabulary(names, sources.concepts).select("name", "match_type", "rxcui", "normalized_name", "match_score", "warning")
    if sources.errors is None:
        matched = matched.withColumn("error", F.lit(None).cast("string"))
    else:
        matched = resolve.with_lookup_errors(matched, sources.errors)
    # The small results of each step are written: several tables and the report follow from them.
    resolved = cut(names.join(matched, "name"))
    last = W.partitionBy("rxcui").orderBy(F.desc("pos"))
    drugs = cut(
        resolved.where(F.col("rxcui").isNotNull())
        .withColumn("_n", F.row_number().over(last)).where("_n = 1")
        .join(sources.related, "rxcui", "left")
        .select(
            tables.natural_id("rxcui").alias("drug_id"), "rxcui", F.coalesce("normalized_name", "name").alias("normalized_name"),
            "term_type", "generic_name", F.col("name").alias("input_name"), "match_type", "match_score",
            F.lit("vocabulary").alias("source"), F.concat(F.lit("vocabulary?rxcui="), "rxcui").alias("source_url"),
            as_of.alias("created_at"), as_of.alias("updated_at"), "brand_names", "synonyms",
        )
    )
    kinds = F.concat(
        F.transform(F.coalesce("brand_names", F.array()), lambda b: F.struct(b.alias("synonym"), F.lit("brand").alias("synonym_type"))),
        F.transform(F.coalesce("synonyms", F.array()), lambda s: F.struct(s.alias("synonym"), F.lit("synonym").alias("synonym_type"))),
    )
    # In stored order; the first of equal ones.
    synonyms = drugs.select("drug_id", F.posexplode(kinds).alias("ord", "k")).groupBy("drug_id", "k.synonym", "k.synonym_type").agg(
        (F.min("ord") + 1).alias("ord"))
    found = sources.found.join(drugs.select("rxcui"), "rxcui", "left_semi")
    # written first: a table of known size, so few wanted documents do not move all texts
    wanted = cut(found.where(F.col("rank") <= vocab.CANDIDATES_CHECKED).select(F.col("setid").alias("doc")).distinct())
    read = sources.documents
    documents = cut(read(wanted) if callable(read) else read.join(wanted, "doc", "left_semi"))
    chosen = cut(choose_labels(found, documents))
    usable = chosen.where(F.col("evidence_status") != "error").select(
        "rxcui", tables.natural_id("rxcui").alias("drug_id"), F.col("setid").alias("doc"),
        first_value("doc_setid", "setid").alias("setid"), first_value("doc_version", "spl_version").alias("spl_version"),
        first_value("doc_title", "title").alias("title"), "manufacturer", "published_date",
        F.concat(F.lit("label?setid="), "setid").alias("source_url"), F.concat(F.lit("labels/"), "setid", F.lit(".xml")).alias("api_url"),
        *LINK_FIELDS,
    ).withColumn("label_id", tables.natural_id("setid", "spl_version"))
    one = W.partitionBy("label_id").orderBy("rxcui")
    labels = usable.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n").withColumn("retrieved_at", as_of).withColumn("updated_at", as_of)
    sections = (
        labels.select("label_id", "doc").join(documents.select("doc", "sections"), "doc")
        .select("label_id", F.explode("sections").alias("s")).select("label_id", "s.*")
        .withColumn("section_id", tables.natural_id("label_id", "section_code")).withColumn("updated_at", as_of)
    )
    links = usable.withColumn("link_id", tables.natural_id("drug_id", "label_id")).withColumn("retrieved_at", as_of)
    return Incoming(resolved, drugs, synonyms, chosen, usable, labels, sections, links)


def merge(new: Incoming, store: Store, as_of: Column) -> tuple[Store, DataFrame]:
    """Next store and one report row per name. Of `store` only the rows that have the keys of `new` matter."""
    synonym_diff = upsert.reconcile(store.drug_synonyms, new.synonyms, new.drugs, "drug_id")
    moved = synonym_diff.where(F.col("status").isin("added", "deleted")).join(new.drugs.select("drug_id", "rxcui"), "drug_id")
    drug_diff = upsert.upsert(store.drugs, new.drugs.drop("brand_names", "synonyms"), ["rxcui"], DRUG_FIELDS, as_of, also_changed=moved)
    label_diff = upsert.upsert(store.labels, new.labels, ["setid", "spl_version"], LABEL_FIELDS, as_of)
    section_diff = upsert.upsert(store.label_sections, new.sections, ["label_id", "section_code"], ["text", "found", "section_name"], as_of)
    link_diff = upsert.upsert(store.drug_label_links, new.links, ["drug_id", "label_id"], LINK_FIELDS, as_of, stamp=None, touch="retrieved_at")

    after = Store(*[upsert.next_table(d) for d in (drug_diff, synonym_diff, label_diff, section_diff, link_diff)])
    report = (
        new.resolved.select("pos", "name", "rxcui", "match_type", "error", "warning")
        .join(drug_diff.select("rxcui", F.col("status").alias("drug_status")), "rxcui", "left")
        .join(new.chosen.select("rxcui", "evidence_status"), "rxcui", "left")
        .join(new.usable.select("rxcui", "drug_id", "label_id"), "rxcui", "left")
        .join(label_diff.select("label_id", F.col("status").alias("label_status")), "label_id", "left")
        .join(link_diff.select("drug_id", "label_id", F.col("status").alias("link_status")), ["drug_id", "label_id"], "left")
        .join(upsert.status_report(section_diff, ["label_id"]), "label_id", "left")
        .select(
            "pos", "name", "rxcui", "match_type", "error", "warning",
            F.when(F.col("rxcui").isNull(), "failed").otherwise(F.col("drug_status")).alias("drug_status"), "label_status", "link_status",
            F.when(F.col("rxcui").isNotNull(), F.coalesce("evidence_status", F.lit("no_label_found"))).alias("evidence_status"),
            *[F.coalesce(s, F.lit(0)).alias(f"sections_{s}") for s in ("added", "updated", "unchanged")],
        )
    )
    return after, report


def ingest(names: DataFrame, store: Store, sources: Sources, as_of: Column) -> tuple[Store, DataFrame]:
    """Next store and one report row per name of (pos, name).

    Several names may mean one drug; its row then comes from the last of them.
    A name that means nothing is reported as failed and changes nothing; one whose
    lookup broke is reported as failed with its error.
    """
    return merge(prepare(names, sources, as_of), store, as_of)


def build_index(store: Store, old: DataFrame, embedder, rxcuis: DataFrame | None = None,
                size: int = vocab.CHUNK_WORDS, overlap: int = vocab.CHUNK_OVERLAP) -> tuple[DataFrame, DataFrame]:
    """Next index and the report of the run, for all drugs or for a table of rxcuis."""
    scope = store.drugs if rxcuis is None else store.drugs.join(rxcuis.select("rxcui").distinct(), "rxcui", "left_semi")
    links = store.drug_label_links
    if rxcuis is not None:
        links = links.join(scope.select("drug_id"), "drug_id", "left_semi")
    slim = lambda df, *drop: df.drop(*drop)
    drugs = slim(scope, "source", "source_url", "created_at", "updated_at", "match_type")
    labels = slim(store.labels, "retrieved_at", "updated_at")
    sections = slim(store.label_sections, "updated_at")
    links = slim(links, "retrieved_at")
    diff = index.index_diff(old, chunking.build_chunks(drugs, labels, sections, links, size, overlap))
    report = index.index_report(diff, chunking.rejects(drugs, labels, sections, links), drugs, labels, sections, links)
    return index.embed_changes(diff, embedder), report
