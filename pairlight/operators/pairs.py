"""Regimens to pairs, pair queries, merged and classified evidence, pair statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlight import vocab
from pairlight.functions import text as tx

PAIR = ["rxcui_a", "rxcui_b"]


def first_spellings(names: Column) -> Column:
    """Array of names without blanks and without later spellings of an earlier name."""
    clean = F.filter(F.transform(names, tx.strip), lambda n: n != "")
    return tx.let(clean, lambda c: tx.let(
        F.transform(c, F.lower), lambda low: F.when(F.size(F.array_distinct(low)) == F.size(low), c).otherwise(
            F.filter(c, lambda n, i: F.array_position(low, F.lower(n)) == i + 1))))


def unordered_pairs(names: Column) -> Column:
    """Array of the pairs of an array of names, in input order."""
    return tx.let(names, lambda all_names: F.flatten(F.transform(
        all_names,
        lambda a, i: F.transform(
            F.slice(all_names, i + 2, F.greatest(F.size(all_names) - i - 1, F.lit(0))),
            lambda b: F.struct(a.alias("drug_a"), b.alias("drug_b")),
        ),
    )))


def check_names(df: DataFrame, name: str = "name") -> DataFrame:
    """Adds clean_name (null if refused) and reason (null if accepted)."""
    return (
        df.withColumn("clean_name", tx.strip(F.col(name)))
        .withColumn("reason", tx.name_problem(F.col("clean_name")))
        .withColumn("clean_name", F.when(F.col("reason").isNull(), F.col("clean_name")))
    )


def check_regimens(names: DataFrame) -> DataFrame:
    """(regimen_id, n_names, names, reason) from rows (regimen_id, pos, name).

    Names are shuffled and sorted once and become rows of at most ten columns by
    their place, so no group holds more than ten names however long an odd list is.
    """
    low, high = vocab.REGIMEN_SIZE
    # Names are cleaned and checked as rows, before they are put beside each other.
    each = names.select("regimen_id", "pos", tx.strip(F.col("name")).alias("_n")).withColumn(
        "_problem", tx.name_problem(F.col("_n")))
    ranked = each.withColumn("_i", F.row_number().over(W.partitionBy("regimen_id").orderBy("pos", "_n")))
    listed = ranked.groupBy("regimen_id").agg(
        F.count("*").alias("n_names"),
        F.min_by("_problem", F.when(F.col("_problem").isNotNull(), F.col("_i"))).alias("_problem"),
        *[F.max(F.when(F.col("_i") == i, F.col("_n"))).alias(f"_{i}") for i in range(1, high + 1)])
    within = F.col("n_names").between(low, high)
    filled = lambda of: F.slice(F.array(*[of(F.col(f"_{i}")) for i in range(1, high + 1)]), F.lit(1), F.col("n_names").cast("int"))
    again = tx.let(F.transform("_clean", F.lower), lambda low: F.sort_array(F.array_distinct(
        F.filter("_clean", lambda n, i: F.array_position(low, F.lower(n)) != i + 1))))
    wrong = (
        F.when(F.col("n_names") < low, F.lit(vocab.REGIMEN_SMALL))
        .when(F.col("n_names") > high, F.format_string(vocab.REGIMEN_LARGE, F.col("n_names"), F.lit(high)))
        .when(F.col("_problem").isNotNull(), F.col("_problem"))
        .when(F.size(F.array_distinct("_low")) < F.size("_low"), F.format_string(vocab.REGIMEN_DUPLICATE, F.array_join(again, ", ")))
    )
    checked = listed.select("regimen_id", "n_names", "_problem", F.when(within, filled(lambda c: c)).alias("_clean"), F.when(within, filled(F.lower)).alias("_low"))
    return checked.withColumn("reason", wrong).select("regimen_id", "n_names", F.when(F.col("reason").isNull(), F.col("_clean")).alias("names"), "reason")


def regimen_pairs(checked: DataFrame) -> DataFrame:
    """(regimen_id, pair_no, drug_a, drug_b) for every accepted regimen, at most 45 pairs each."""
    names = checked.where(F.col("reason").isNull()).select("regimen_id", first_spellings(F.col("names")).alias("_l"))
    first = names.select("regimen_id", "_l", F.posexplode("_l").alias("_i", "drug_a"))
    i, n = F.col("_i"), F.size("_l")
    later = F.slice("_l", i + 2, F.greatest(n - i - 1, F.lit(0)))
    return (
        first.select("regimen_id", "drug_a", (i * (2 * n - i - 1) / 2).cast("int").alias("_before"), F.posexplode(later).alias("_j", "drug_b"))
        .select("regimen_id", (F.col("_before") + F.col("_j") + 1).alias("pair_no"), "drug_a", "drug_b")
    )


def drug_cards(drugs: DataFrame, terms: DataFrame, limit: int = vocab.MAX_VARIANTS) -> DataFrame:
    """One row per drug with its first distinct name variants, else the name as typed."""
    first = terms.where(F.col("term") != "").groupBy("rxcui", F.lower("term").alias("_l")).agg(
        F.min_by("term", "ord").alias("term"), F.min("ord").alias("ord")
    )
    place = W.partitionBy("rxcui").orderBy("ord")
    variants = (
        first.withColumn("_n", F.row_number().over(place))
        .where(F.col("_n") <= limit)
        .groupBy("rxcui")
        .agg(F.sort_array(F.collect_list(F.struct("_n", "term"))).alias("_v"))
        .select("rxcui", F.transform("_v", lambda v: v["term"]).alias("variants"))
    )
    return drugs.select("rxcui", "normalized_name", "input_name").join(variants, "rxcui", "left").select(
        "rxcui", "normalized_name", F.coalesce("variants", F.array("input_name")).alias("variants")
    )


def pair_queries(pairs: DataFrame, cards: DataFrame) -> DataFrame:
    """(rxcui_a, rxcui_b, ord, query, query_type, scope) for distinct ordered pairs of known drugs."""
    side = lambda s: cards.select(
        F.col("rxcui").alias(f"rxcui_{s}"), F.col("variants").alias(f"_v{s}")
    )
    both = pairs.select(*PAIR).join(side("a"), "rxcui_a").join(side("b"), "rxcui_b")
    a, b = F.col("_va"), F.col("_vb")
    entry = lambda q, t: F.struct(tx.strip(q).alias("query"), F.lit(t).alias("query_type"))
    crossed = F.flatten(F.transform(a, lambda x: F.transform(
        b, lambda y: entry(F.concat(x, F.lit(" and "), y, F.lit(" interaction")), "pair_specific")
    )))
    fixed = F.array(
        entry(F.concat(a[0], F.lit(" "), b[0]), "pair_specific"),
        entry(F.concat(a[0], F.lit(" drug interactions")), "drug_a_specific"),
        entry(F.concat(a[0], F.lit(" interaction warnings")), "drug_a_specific"),
        entry(F.concat(b[0], F.lit(" drug interactions")), "drug_b_specific"),
        entry(F.concat(b[0], F.lit(" interaction warnings")), "drug_b_specific"),
    )
    every = F.filter(F.concat(crossed, fixed), lambda e: e["query"] != "")
    unique = tx.let(every, lambda q: tx.let(
        F.transform(q, lambda e: F.lower(e["query"])),
        lambda low: F.filter(q, lambda e, i: F.array_position(low, F.lower(e["query"])) == i + 1)))
    scope = (
        F.when(F.col("query_type") == "drug_a_specific", F.array("rxcui_a"))
        .when(F.col("query_type") == "drug_b_specific", F.array("rxcui_b"))
        .otherwise(F.sort_array(F.array(*PAIR)))
    )
    return (
        both.select(*PAIR, F.posexplode(unique).alias("_i", "_e"))
        .select(*PAIR, (F.col("_i") + 1).alias("ord"), "_e.query", "_e.query_type")
        .withColumn("scope", scope)
        .withColumn("search_id", F.sha2(F.concat_ws("\x1f", "scope", F.lower("query")), 256))
    )


def distinct_searches(queries: DataFrame) -> DataFrame:
    """Each (scope, query text in any case) once, so that pairs which share a search share its result."""
    return queries.groupBy("search_id").agg(F.min("query").alias("query"), F.first("scope").alias("scope"))


def merge_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per (pair, chunk): smallest distance and the queries that found it, in query order.

    `hits` holds (search_id, chunk_id, distance, rank). A group has at most one
    row per query of a pair, that is nine.
    """
    seen = F.sort_array(F.collect_list(F.struct("ord", "rank", "query", "query_type")))
    return (
        queries.join(hits, "search_id")
        .groupBy(*PAIR, "chunk_id")
        .agg(F.min("distance").alias("distance"), seen.alias("_s"))
        .select(
            *PAIR, "chunk_id", "distance",
            F.transform("_s", lambda s: s["query"]).alias("retrieval_queries"),
            F.transform("_s", lambda s: s["query_type"]).alias("retrieval_query_types"),
            F.col("_s")[0]["ord"].alias("first_ord"), F.col("_s")[0]["rank"].alias("first_rank"),
        )
    )


def classify(items: DataFrame, mentions: DataFrame, class_hits: DataFrame, names: DataFrame) -> DataFrame:
    """Class of each (pair, chunk) row that carries the chunk's own rxcui.

    mentions:   (chunk_id, rxcui, matched_terms)
    class_hits: (chunk_id, member, class_term), member in lower case
    names:      (rxcui, normalized_name)
    """
    out = items.withColumnRenamed("rxcui", "_own")
    for s in ("a", "b"):
        out = (
            out.join(names.select(F.col("rxcui").alias(f"rxcui_{s}"), tx.fold(F.col("normalized_name")).alias(f"_n{s}")),
                     f"rxcui_{s}", "left")
            .join(mentions.select("chunk_id", F.col("rxcui").alias(f"rxcui_{s}"),
                                  F.col("matched_terms").alias(f"matched_terms_{s}")),
                  ["chunk_id", f"rxcui_{s}"], "left")
            .join(class_hits.select("chunk_id", F.col("member").alias(f"_n{s}"), F.col("class_term").alias(f"_c{s}")),
                  ["chunk_id", f"_n{s}"], "left")
            .withColumn(f"matched_terms_{s}", F.coalesce(f"matched_terms_{s}", F.array().cast("array<string>")))
            .withColumn(f"mentions_{s}", (F.size(f"matched_terms_{s}") > 0)
                        | F.coalesce(F.col("_own") == F.col(f"rxcui_{s}"), F.lit(False)))
            .withColumn(f"class_match_{s}", F.when(~F.col(f"mentions_{s}"), F.col(f"_c{s}")))
        )
    a, b = F.col("mentions_a"), F.col("mentions_b")
    label = (
        F.when(a & b, vocab.PAIR_SPECIFIC)
        .when((a & F.col("class_match_b").isNotNull()) | (b & F.col("class_match_a").isNotNull()), vocab.CLASS_LEVEL)
        .when(a | b, vocab.DRUG_SPECIFIC)
        .otherwise(vocab.GENERAL_LABEL)
    )
    return out.withColumn("classification", label).withColumnRenamed("_own", "rxcui").drop("_na", "_nb", "_ca", "_cb")


def rank_evidence(items: DataFrame, cap: int = vocab.MAX_EVIDENCE) -> DataFrame:
    """Adds place and, for the first `cap` items of a pair, evidence_id.

    Pair-specific items come first, then the others by kind, each by distance;
    ties keep the order in which the items were first found.
    """
    kind = F.array_position(F.array(*[F.lit(c) for c in (vocab.PAIR_SPECIFIC, *vocab.SUPPORT_ORDER)]),
                            F.col("classification"))
    place = W.partitionBy(*PAIR).orderBy(kind, "distance", "first_ord", "first_rank", "chunk_id")
    return items.withColumn("place", F.row_number().over(place)).withColumn(
        "evidence_id", F.when(F.col("place") <= cap, F.format_string("EVIDENCE-%03d", F.col("place")))
    )


def pair_counts(evidence: DataFrame) -> DataFrame:
    pair_specific = F.col("classification") == vocab.PAIR_SPECIFIC
    return evidence.groupBy(*PAIR).agg(
        F.count_if(pair_specific).alias("n_pair_specific"), F.count_if(~pair_specific).alias("n_supporting")
    )


def pair_status(resolved: DataFrame, counts: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Adds the one status of each pair, with rxcui_a / rxcui_b null where a name is unknown.

    `failed` may list pairs (rxcui_a, rxcui_b) whose search broke. The absence of
    evidence is only ever reported as such.
    """
    out = resolved.join(counts, PAIR, "left")
    if failed is not None:
        out = out.join(failed.select(*PAIR).distinct().withColumn("_failed", F.lit(True)), PAIR, "left")
    else:
        out = out.withColumn("_failed", F.lit(False))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = (
        F.when(F.col("rxcui_a").isNull() | F.col("rxcui_b").isNull(), vocab.NOT_FOUND)
        .when(F.col("rxcui_a") == F.col("rxcui_b"), vocab.INVALID)
        .when(F.coalesce("_failed", F.lit(False)), vocab.RETRIEVAL_ERROR)
        .when(n("n_pair_specific") > 0, vocab.PAIR_FOUND)
        .when(n("n_supporting") > 0, vocab.SUPPORT_FOUND)
        .otherwise(vocab.INSUFFICIENT)
    )
    return (
        out.withColumn("evidence_status", status)
        .withColumn("n_pair_specific", n("n_pair_specific"))
        .withColumn("n_supporting", n("n_supporting"))
        .drop("_failed")
    )


def regimen_report(pairs: DataFrame, statuses: DataFrame) -> DataFrame:
    """Pairs per regimen by status."""
    rows = pairs.join(statuses.select("drug_a", "drug_b", "evidence_status"), ["drug_a", "drug_b"])
    count = lambda s: F.count_if(F.col("evidence_status") == s)
    return rows.groupBy("regimen_id").agg(
        F.count("*").alias("total_pairs"),
        count(vocab.PAIR_FOUND).alias("n_pair_specific"),
        count(vocab.SUPPORT_FOUND).alias("n_supporting"),
        count(vocab.INSUFFICIENT).alias("n_insufficient"),
        count(vocab.NOT_FOUND).alias("n_not_found"),
        count(vocab.INVALID).alias("n_invalid"),
        count(vocab.RETRIEVAL_ERROR).alias("n_error"),
    )


def with_status_label(df: DataFrame, status: str = "evidence_status") -> DataFrame:
    """Adds label, tone and description of a status, with the status itself as default label."""
    table = lambda i: F.create_map(*[F.lit(v) for k, row in vocab.STATUS_LABELS.items() for v in (k, row[i])])
    s = F.col(status)
    known = F.nullif(s, F.lit(""))
    return (
        df.withColumn("label", F.coalesce(F.try_element_at(table(0), s), known, F.lit("Unknown")))
        .withColumn("tone", F.coalesce(F.try_element_at(table(1), s), F.lit("neutral")))
        .withColumn("description", F.coalesce(F.try_element_at(table(2), s), F.lit("")))
    )


def classification_label(c: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in vocab.CLASSIFICATION_LABELS.items() for v in kv])
    return F.coalesce(F.try_element_at(table, c), F.nullif(c, F.lit("")), F.lit("Evidence"))
