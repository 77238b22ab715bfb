"""The given tables in the roles of drugs, labels, sections, names and answers.

The operators know nothing of this module. Roles:

drug      one per documents.source; its names are words of benchmark texts
label     one per document; seven sections dealt out by line number
regimen   the lines of an order, each naming a drug in some spelling
answer    assistant turns of conversations, wrapped as JSON
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairlight import vocab
from pairlight.functions import text as tx
from pairlight.functions.vectors import HashEmbedder
from pairlight.operators import chunking, pairs
from pairlight.plans.pair_evidence import Knowledge, resolve_pairs
from pairlight.session import cut

DRUGS = 20
DIM = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drug_number(source: Column) -> Column:
    return F.substring(source, 4, 10).cast("long")


def word_counts(spark: SparkSession, sf: str, size: Column) -> DataFrame:
    words = table(spark, sf, "benchmark").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("word"))
    return words.where(size).groupBy("word").agg(F.count("*").alias("n"))


def name_words(spark: SparkSession, sf: str) -> DataFrame:
    """(drug_id, term, ord): words of seven letters and more, dealt to drugs by hash, frequent ones first."""
    owner = F.conv(F.substring(F.md5("word"), 1, 4), 16, 10).cast("long") % DRUGS
    return word_counts(spark, sf, F.length("word") >= 7).withColumn("drug_id", owner).select(
        "drug_id", F.col("word").alias("term"),
        F.row_number().over(W.partitionBy("drug_id").orderBy(F.desc("n"), "word")).alias("ord"),
    )


def drugs(spark: SparkSession, sf: str) -> DataFrame:
    owners = table(spark, sf, "documents").select(drug_number(F.col("source")).alias("drug_id")).distinct()
    first = name_words(spark, sf).where("ord = 1").select("drug_id", F.col("term").alias("normalized_name"))
    return owners.join(first, "drug_id", "left").select(
        "drug_id", (F.col("drug_id") + 1000).cast("string").alias("rxcui"), "normalized_name",
        F.col("normalized_name").alias("generic_name"), F.initcap("normalized_name").alias("input_name"),
    )


def synonyms(spark: SparkSession, sf: str) -> DataFrame:
    return name_words(spark, sf).where("ord > 1").select(
        "drug_id", F.col("term").alias("synonym"),
        F.when(F.col("ord") % 2 == 0, "brand").otherwise("synonym").alias("synonym_type"), "ord",
    )


def classes(spark: SparkSession, sf: str, stored: DataFrame | None = None) -> DataFrame:
    """Words of six letters are class terms, declared in the order of their hashes and dealt by them to five classes.

    A class has every drug whose number leaves the class modulo five.
    """
    code = F.conv(F.substring(F.md5("word"), 1, 12), 16, 10).cast("long")
    declared = word_counts(spark, sf, F.length("word") == 6).select(F.col("word").alias("class_term"), code.alias("ord"), (code % 5).alias("_c"))
    members = (drugs(spark, sf) if stored is None else stored).where(F.col("normalized_name").isNotNull()).select(
        (F.col("drug_id") % 5).alias("_c"), F.lower("normalized_name").alias("member"))
    return declared.join(members, "_c").drop("_c")


def sections(spark: SparkSession, sf: str) -> DataFrame:
    """Seven sections per document: section k holds the lines whose number leaves k modulo seven."""
    keys = F.array(*[F.struct(F.lit(k).alias("section_key"), F.lit(c).alias("section_code"), F.lit(n).alias("section_name"))
                     for k, (c, n) in vocab.SECTIONS.items()])
    parts = tx.let(F.split("text", "\n"), lambda lines: F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: tx.squish(
        F.array_join(F.filter(lines, lambda x, i: i % 7 == k), " "))))
    return (
        table(spark, sf, "documents")
        .select(F.col("doc_id").alias("label_id"), F.posexplode(parts).alias("k", "raw"))
        .select(
            "label_id", (F.col("label_id") * 7 + F.col("k")).alias("section_id"), keys[F.col("k")].alias("s"),
            F.when(tx.meaningful(F.col("raw")), F.col("raw")).otherwise("").alias("text"),
            tx.meaningful(F.col("raw")).alias("found"),
        )
        .select("label_id", "section_id", "s.section_key", "s.section_code", "s.section_name", "text", "found")
    )


def labels(spark: SparkSession, sf: str) -> DataFrame:
    set_id = F.concat(F.lit("set-"), F.col("doc_id"))
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("label_id"), set_id.alias("setid"),
        F.when(F.col("lang") != "es", F.col("n_chars").cast("string")).alias("spl_version"),
        F.concat(F.lit("label "), F.col("doc_id")).alias("title"), F.col("lang").alias("manufacturer"),
        F.lit(None).cast("string").alias("published_date"),
        F.concat(F.lit("label?setid="), set_id).alias("source_url"), F.concat(set_id, F.lit(".xml")).alias("api_url"),
    )


def links(spark: SparkSession, sf: str) -> DataFrame:
    """One link per document, without a drug where the source is unknown."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("link_id"), drug_number(F.col("source")).alias("drug_id"),
        F.col("doc_id").alias("label_id"),
        F.when(F.col("n_chars") > 100, "interaction_evidence_found").otherwise("label_found_no_interaction_section")
        .alias("evidence_status"),
        F.lit(1).alias("candidates_checked"), F.lit(1).alias("total_candidates_found"),
    )


def chunks(spark: SparkSession, sf: str, stored: DataFrame | None = None) -> DataFrame:
    known = drugs(spark, sf) if stored is None else stored
    return chunking.build_chunks(known, labels(spark, sf), sections(spark, sf), links(spark, sf))


EMBEDDER = HashEmbedder(DIM)


def knowledge(spark: SparkSession, sf: str) -> Knowledge:
    """Stored tables and the stored index, written to the work folder as a load would leave them."""
    stored = cut(drugs(spark, sf))
    return Knowledge(
        stored, cut(synonyms(spark, sf)), cut(classes(spark, sf, stored)),
        cut(EMBEDDER(chunks(spark, sf, stored), "text", "embedding")),
    )


def regimens(spark: SparkSession, sf: str, known: Knowledge | None = None) -> DataFrame:
    """(regimen_id, pos, name): each order line names drug l_partkey mod 20 in a spelling that its flags pick."""
    stored, other = (drugs(spark, sf), synonyms(spark, sf)) if known is None else (known.drugs, known.synonyms)
    names = cut(stored.join(
        other.where("ord = 2").select("drug_id", F.col("synonym").alias("other")), "drug_id", "left"
    ).select(F.col("drug_id").alias("_d"), "rxcui", "normalized_name", "other"))
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag",
        "l_linestatus", (F.col("l_partkey") % DRUGS).alias("_d"))
    flag, state = F.col("l_returnflag"), F.col("l_linestatus")
    name = (
        F.when(F.col("l_quantity") >= 50, F.concat(F.lit("<"), F.col("normalized_name"), F.lit(">")))
        .when(F.col("l_quantity") < 2, F.concat(F.lit("unlisted-"), F.col("l_linenumber")))
        .when((flag == "R") & (state == "O"), F.col("rxcui"))
        .when(flag == "R", F.initcap("normalized_name"))
        .when(flag == "A", F.concat(F.lit("  "), F.upper(F.coalesce("other", "normalized_name")), F.lit(" ")))
        .otherwise(F.col("normalized_name"))
    )
    return lines.join(names, "_d").select(
        F.col("l_orderkey").alias("regimen_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag",
                 "l_linestatus").alias("pos"),
        name.alias("name"),
    )


def all_pairs(spark: SparkSession, sf: str, known: Knowledge) -> DataFrame:
    """Distinct (drug_a, drug_b) asked for in the accepted regimens, with their ids."""
    asked = pairs.regimen_pairs(pairs.check_regimens(regimens(spark, sf, known)))
    return resolve_pairs(asked, known)


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """(answer_id, rxcui_a, rxcui_b, provider, raw_text): one answer per conversation turn.

    Assistant turns become JSON, some fenced, some with a wrong shape; other turns
    stay the plain text they are, which is no valid answer.
    """
    turns = table(spark, sf, "conversations").withColumn("n", F.length("text"))
    a = F.col("conv_id") % DRUGS
    b = (F.col("conv_id") + F.col("turn") % 5 + 1) % DRUGS
    n, text = F.col("n"), F.col("text")
    words = F.split(tx.squish(text), " ")
    assessment = F.when(n % 5 == 0, vocab.INSUFFICIENT).when(n % 5 < 4, vocab.SUPPORT_FOUND).otherwise(vocab.PAIR_FOUND)
    notice = F.when(n % 11 == 0, F.lit("See www.example.org")).when(n % 13 == 0, F.lit("They are Safe to combine.")) \
        .otherwise(F.lit("Ask a pharmacist."))
    good = F.to_json(F.struct(
        F.when(n % 17 == 0, F.lit("certain")).otherwise(assessment).alias("interaction_assessment"),
        text.alias("evidence_summary"),
        F.when(n % 3 == 0, F.get(words, F.lit(0))).alias("clinical_effect"),
        F.when(n % 7 == 0, F.lit(" ")).alias("mechanism"),
        F.when(n % 2 == 0, F.get(words, F.lit(1))).when(n % 4 == 1, F.lit("None")).alias("severity"),
        F.array(F.format_string("EVIDENCE-%03d", (n % 8 + 1).cast("int")),
                F.format_string("EVIDENCE-%03d", (n % 9 + 1).cast("int"))).alias("cited_evidence_ids"),
        F.array(F.get(words, F.lit(0))).alias("limitations"),
        notice.alias("safety_notice"),
    ), {"ignoreNullFields": "false"})
    raw = (
        F.when(F.col("role") != "assistant", text)
        .when(n % 6 == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(n % 19 == 0, F.concat(F.lit('{"extra": 1, '), F.substring(good, 2, 1000000000)))
        .otherwise(good)
    )
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("answer_id"),
        (a + 1000).cast("string").alias("rxcui_a"), (b + 1000).cast("string").alias("rxcui_b"),
        F.lit("OpenRouter").alias("provider"), raw.alias("raw_text"),
    )
