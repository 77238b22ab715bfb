"""Whole-word dictionary matching as an equi-join on words and on runs of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlight.functions import text as tx
from pairlight.session import cut


def _windows(units: Column, size: int, first: int) -> Column:
    """Runs of `size` units that begin at every second unit from the `first` on."""
    last = F.size(units) - size + 1
    runs = F.transform(F.sequence(F.lit(first), last, F.lit(2)), lambda i: F.array_join(F.slice(units, i, size), ""))
    return F.when(last >= first, runs).otherwise(F.array().cast("array<string>"))


def match_terms(texts: DataFrame, terms: DataFrame, key: str = "chunk_id", text: str = "text",
                term: str = "term") -> DataFrame:
    """(key, term) for every term that occurs in a text as whole words, in any case.

    Terms and texts are sequences of units, words and what stands between them in
    turn, and a term occurs where its units are a run of the text's. So texts are
    cut into runs of as many units as the dictionary's terms have, and joined to
    the terms by equality; a text is read once, whatever it holds. A term that
    begins or ends with other signs than words needs a word beyond them, so the
    signs at a text's ends open and close no run. Repeated terms count once, blank
    ones never; null texts hold nothing.
    """
    entries = cut(
        terms.select(F.col(term).alias("_term"))
        .where(tx.strip(F.col(term)) != "")
        .distinct()
        .withColumn("_key", tx.fold(F.col("_term")))
        .withColumn("_size", F.size(tx.units(F.col("_key"))))
        .withColumn("_first", F.when(F.col("_key").rlike(f"^{tx.WORD}"), 1).otherwise(2))
    )
    # As many rows as terms have different lengths.
    kinds = sorted((r["_size"], r["_first"]) for r in entries.select("_size", "_first").distinct().collect())
    if not kinds:
        return texts.join(entries, F.lit(False)).select(key, F.col("_term").alias(term))
    longer = [k for k in kinds if k != (1, 1)]
    within = tx.units(F.regexp_replace(F.col(text), f"^{tx.OTHER}+|{tx.OTHER}+$", ""))
    runs = [tx.tokens(F.col(text))] * ((1, 1) in kinds)
    if longer:
        runs.append(tx.let(within, lambda u: F.concat(*[_windows(u, *k) for k in longer])))
    words = texts.select(F.col(key).alias("_id"), F.explode(F.array_distinct(F.concat(*runs))).alias("_key"))
    return words.join(entries.select("_key", "_term"), "_key").select(F.col("_id").alias(key), F.col("_term").alias(term))


def by_owner(found: DataFrame, owner_terms: DataFrame, key: str = "chunk_id", owner: str = "rxcui") -> DataFrame:
    """(key, owner, matched_terms) from (key, term): the owner's terms in the owner's order."""
    return (
        found.join(owner_terms.select(owner, "term", "ord"), "term")
        .groupBy(key, owner)
        .agg(F.sort_array(F.collect_list(F.struct("ord", "term"))).alias("_t"))
        .select(key, owner, F.transform("_t", lambda t: t["term"]).alias("matched_terms"))
    )


def by_class(found: DataFrame, classes: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, member, class_term) from (key, term): first class term, by declaration order, that has the member.

    `classes` has one row per (class_term, ord, member).
    """
    return (
        found.join(classes.withColumnRenamed("class_term", "term"), "term")
        .groupBy(key, "member")
        .agg(F.min_by("term", "ord").alias("class_term"))
    )


def owner_mentions(texts: DataFrame, owner_terms: DataFrame, key: str = "chunk_id", text: str = "text",
                   owner: str = "rxcui") -> DataFrame:
    return by_owner(match_terms(texts, owner_terms, key, text, "term"), owner_terms, key, owner)


def class_mentions(texts: DataFrame, classes: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    terms = classes.select(F.col("class_term").alias("term"))
    return by_class(match_terms(texts, terms, key, text, "term"), classes, key)
