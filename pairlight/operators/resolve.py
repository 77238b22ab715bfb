"""Name search, name resolution and vocabulary matching, all as equi-joins on substrings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlight import vocab
from pairlight.functions import text as tx
from pairlight.session import cut


_LONGEST = 4


def _pieces(text: Column) -> Column:
    """All substrings of one to four characters, and the empty one."""
    return F.array_distinct(F.concat(F.array(F.lit("")), *[tx.grams(text, n) for n in range(1, _LONGEST + 1)]))


def _query_pieces(query: Column) -> Column:
    """Substrings any match of a LIKE pattern must hold: those of its literal runs, of the longest size."""
    runs = F.filter(F.split(query, "[%_]"), lambda r: r != "")
    found = F.array(F.lit(""))
    for n in range(1, _LONGEST + 1):
        of = F.flatten(F.transform(runs, lambda r: tx.grams(r, n)))  # noqa: B023
        found = F.when(F.size(of) > 0, F.array_distinct(of)).otherwise(found)
    return found


def _pattern(query: Column) -> Column:
    """The LIKE pattern of a query; a run of wildcards becomes its _ and at most one %, which no text makes a matcher try over and over."""
    every = F.concat(F.lit("%"), F.replace(query, F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    runs = F.regexp_extract_all(every, F.lit("([%_]+|[^%_]+)"))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[%_]*%"), F.concat(F.replace(r, F.lit("%"), F.lit("")), F.lit("%"))).otherwise(r)), "")


def search_terms(drugs: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Searchable (drug_id, kind, term): names are kind 0, synonyms kind 1."""
    names = drugs.select(
        "drug_id", F.lit(0).alias("kind"),
        F.explode(F.array_distinct(F.array("normalized_name", "input_name", "generic_name"))).alias("term"),
    ).where(F.col("term").isNotNull())
    return names.unionByName(synonyms.select("drug_id", F.lit(1).alias("kind"), F.col("synonym").alias("term")))


def search_names(queries: DataFrame, terms: DataFrame, query: str = "query") -> DataFrame:
    """(query, drug_id, kind) for each drug with a term that holds the query; kind is the best kind of term.

    The query is stripped and matched in lower case; % and _ in it work as
    wildcards. The rarest of the substrings that every match must hold is the
    join key, so frequent substrings do not decide the size of the join; the
    pattern itself settles each candidate. Queries that are shorter than four
    characters, or wildcards only, use shorter keys, so nothing is missed. Of the
    terms' substrings only those that some query must hold are shuffled.
    """
    asked = (
        queries.select(F.col(query).alias("_raw")).distinct()
        .withColumn("_q", tx.fold(F.col("_raw")))
    )
    distinct_terms = terms.select(F.lower("term").alias("_t")).distinct()
    wanted = asked.select("_raw", "_q", F.explode(_query_pieces(F.col("_q"))).alias("_g"))
    pieces = distinct_terms.select("_t", F.explode(_pieces(F.col("_t"))).alias("_g")).join(wanted.select("_g").distinct(), "_g", "left_semi")
    common = pieces.groupBy("_g").agg(F.count("*").alias("_n"))
    rarest = (
        wanted.join(common, "_g", "left")
        .groupBy("_raw", "_q")
        .agg(F.min_by("_g", F.struct(F.coalesce("_n", F.lit(0)), "_g")).alias("_g"))
        .select("_raw", "_g", _pattern(F.col("_q")).alias("_p"))
    )
    hits = (
        rarest.join(pieces, "_g")
        .where(F.expr("_t like _p"))
        .select("_raw", "_t")
    )
    return (
        hits.join(terms.select("drug_id", "kind", F.lower("term").alias("_t")), "_t")
        .groupBy(F.col("_raw").alias(query), "drug_id")
        .agg(F.min("kind").alias("kind"))
    )


def resolve_drugs(names: DataFrame, drugs: DataFrame, synonyms: DataFrame, name: str = "name") -> DataFrame:
    """(name, rxcui) for each distinct name, rxcui null if unknown.

    All digits: the id itself first. Else the name search, an exact normalized
    name before any other, then names before synonyms, then the lowest drug id.
    """
    distinct = names.select(F.col(name).alias("_raw")).distinct().withColumn("_clean", tx.strip(F.col("_raw")))
    by_id = (
        distinct.where(F.col("_clean").rlike(r"^[0-9]+\z"))
        .join(drugs.select(F.col("rxcui").alias("_clean"), "rxcui"), "_clean")
        .select("_raw", "rxcui", F.struct(F.lit(0).alias("t"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("d")).alias("_o"))
    )
    found = search_names(distinct.select(F.col("_raw").alias("query")), search_terms(drugs, synonyms))
    by_name = (
        found.withColumnRenamed("query", "_raw")
        .join(drugs.select("drug_id", "rxcui", "normalized_name"), "drug_id")
        .select("_raw", "rxcui", F.struct(
            F.when(F.lower("normalized_name") == tx.fold(F.col("_raw")), 1).otherwise(2).alias("t"),
            F.col("kind").alias("k"), F.col("drug_id").cast("long").alias("d")).alias("_o"))
    )
    best = by_id.unionByName(by_name).groupBy("_raw").agg(F.min_by("rxcui", "_o").alias("rxcui"))
    return distinct.select("_raw").join(best, "_raw", "left").withColumnRenamed("_raw", name)


def unknown_names(names: DataFrame, drugs: DataFrame, synonyms: DataFrame, name: str = "name") -> DataFrame:
    """Distinct names that still have to be ingested."""
    return resolve_drugs(names, drugs, synonyms, name).where(F.col("rxcui").isNull()).select(name)


def match_vocabulary(
    names: DataFrame, concepts: DataFrame, name: str = "name",
    min_score: float = vocab.MIN_MATCH_SCORE, keep: int = vocab.MAX_MATCHES,
) -> DataFrame:
    """Resolve names against (rxcui, concept_name): exact, approximate, none.

    Exact means equal up to case, punctuation and spacing. The score of an
    approximate match is 100 times the Dice coefficient of the two names'
    trigrams. Two names can only reach `min_score` if they share one of the
    rarest trigrams of each, early enough in both, so only those are joined
    (prefix and positional filtering, as in set similarity joins): no candidate
    is lost, and a trigram that most names have is rarely a join key.
    """
    asked = names.select(F.col(name).alias("_raw")).distinct()
    # Several branches read both sides: each is written once, with its keys.
    asked = cut(asked.withColumn("_k", tx.match_key(F.col("_raw"))))
    known = cut(concepts.select("rxcui", "concept_name", tx.match_key(F.col("concept_name")).alias("_k")))
    exact = (
        asked.where(F.col("_k") != "").join(known.where(F.col("_k") != ""), "_k")
        .groupBy("_raw").agg(F.min_by(F.struct("rxcui", "concept_name"), "rxcui").alias("_hit"))
        .select("_raw", F.lit("exact").alias("match_type"), "_hit.rxcui", F.col("_hit.concept_name").alias("normalized_name"),
                F.lit(None).cast("double").alias("match_score"),
                F.array().cast("array<struct<rxcui:string,score:double>>").alias("other_candidates"))
    )
    rest = asked.where(F.col("_k") != "").join(exact.select("_raw"), "_raw", "left_anti")
    threshold = min_score / 100.0

    padded = lambda k: tx.grams(F.concat(F.lit("  "), k, F.lit(" ")), 3)
    left = rest.select(F.col("_k").alias("_lk")).distinct().withColumn("_lg", padded(F.col("_lk")))
    right = known.where(F.col("_k") != "").select(F.col("_k").alias("_rk")).distinct().withColumn("_rg", padded(F.col("_rk")))
    common = right.select(F.explode("_rg").alias("_g")).groupBy("_g").agg(F.count("*").alias("_n"))

    def rare_first(df: DataFrame, key: str, side: str) -> DataFrame:
        """Key grams of each name, rarest first: all but those that cannot be the only shared ones."""
        gram, size, at = f"_{side}g", f"_{side}n", f"_{side}p"
        # dice >= t with o shared grams needs o >= n * t / (2 - t) on each side.
        need = F.ceil(F.size(gram) * F.lit(threshold / (2.0 - threshold)) - F.lit(1e-9)).cast("int")
        ordered = (
            df.select(key, gram, F.explode(gram).alias("_g"))
            .join(common, "_g", "left")
            .groupBy(key)
            .agg(F.first(gram).alias(gram),
                 F.sort_array(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_g").alias("g")))).alias("_o"))
        )
        return ordered.select(
            key, gram, F.size(gram).alias(size), F.posexplode(F.slice("_o", F.lit(1), F.size(gram) - need + 1)).alias(at, "_p")
        ).select(key, gram, size, at, F.col("_p.g").alias("_g"))

    # A pair that first meets at these places can share no more grams than are left on either side.
    reachable = 200.0 * F.least(F.col("_ln") - F.col("_lp"), F.col("_rn") - F.col("_rp")) >= (
        min_score * (F.col("_ln") + F.col("_rn")) - 1e-6)
    pairs = (
        rare_first(left, "_lk", "l").join(rare_first(right, "_rk", "r"), "_g")
        .where(reachable)
        .withColumn("_s", F.round(
            200.0 * F.size(F.array_intersect("_lg", "_rg")) / (F.col("_ln") + F.col("_rn")), 6))
        .where(F.col("_s") >= min_score)
        .select("_lk", "_rk", "_s").distinct()
    )
    place = W.partitionBy("_raw").orderBy(F.desc("_s"), "rxcui")
    approx = (
        pairs.join(rest.select("_raw", F.col("_k").alias("_lk")), "_lk")
        .join(known.select("rxcui", "concept_name", F.col("_k").alias("_rk")), "_rk")
        .withColumn("_n", F.row_number().over(place))
        .where(F.col("_n") <= keep)
        .groupBy("_raw")
        .agg(F.sort_array(F.collect_list(F.struct("_n", "rxcui", "concept_name", "_s"))).alias("_c"))
        .select("_raw", F.lit("approximate").alias("match_type"), F.col("_c")[0]["rxcui"].alias("rxcui"),
                F.col("_c")[0]["concept_name"].alias("normalized_name"), F.col("_c")[0]["_s"].alias("match_score"),
                F.transform(F.slice("_c", 2, keep), lambda c: F.struct(c["rxcui"].alias("rxcui"), c["_s"].alias("score")))
                .alias("other_candidates"))
    )
    hits = exact.unionByName(approx)
    empty = F.array().cast("array<struct<rxcui:string,score:double>>")
    return asked.select("_raw").join(hits, "_raw", "left").select(
        F.col("_raw").alias(name), F.coalesce("match_type", F.lit("none")).alias("match_type"), "rxcui",
        "normalized_name", "match_score", F.coalesce("other_candidates", empty).alias("other_candidates"),
        F.when(F.col("match_type") == "approximate", F.format_string(
            "closest match '%s' (score %.0f of 100), please confirm", F.col("normalized_name"), F.col("match_score")
        )).alias("warning"),
    )


def with_lookup_errors(resolved: DataFrame, errors: DataFrame, name: str = "name") -> DataFrame:
    """Names whose lookup broke become match_type error, never none, and have no candidates. `errors` has (name, error)."""
    out = resolved.join(errors.groupBy(name).agg(F.min("error").alias("error")), name, "left")
    broken = F.col("error").isNotNull()
    for c in ("rxcui", "normalized_name", "match_score"):
        out = out.withColumn(c, F.when(~broken, F.col(c)))
    if "other_candidates" in resolved.columns:
        out = out.withColumn("other_candidates", F.when(broken, F.filter("other_candidates", lambda _: F.lit(False))).otherwise(F.col("other_candidates")))
    out = out.withColumn("warning", F.when(broken, F.lit(vocab.LOOKUP_FAILED)).otherwise(F.col("warning")))
    return out.withColumn("match_type", F.when(broken, F.lit("error")).otherwise(F.col("match_type")))


def related_concepts(df: DataFrame, rxcui: str = "rxcui", groups: str = "concept_groups",
                     limit: int = vocab.MAX_RELATED) -> DataFrame:
    """Own term type, brand names, generic name and synonyms from one row's nested concept groups.

    A document carries its own groups, so this is array work within a row and
    needs no shuffle.
    """
    props = lambda g: F.coalesce(g["conceptProperties"], F.array())
    g = F.coalesce(F.col(groups), F.array())

    def names_of(types: tuple[str, ...]) -> Column:
        chosen = F.filter(g, lambda x: x["tty"].isin(*types))
        names = F.flatten(F.transform(chosen, lambda x: F.transform(
            F.coalesce(x["conceptProperties"], F.array()), lambda p: p["name"])))
        return F.slice(F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != ""))), 1, limit)

    own = F.filter(g, lambda x: F.exists(F.coalesce(x["conceptProperties"], F.array()), lambda p: p["rxcui"] == F.col(rxcui)))
    generic = F.filter(
        F.transform(F.filter(g, lambda x: x["tty"].isin(*vocab.GENERIC_TYPES)), lambda x: F.get(x["conceptProperties"], F.lit(0))["name"]),
        lambda n: n.isNotNull(),
    )
    return df.select(
        *[c for c in df.columns if c != groups],
        F.get(own, F.size(own) - 1)["tty"].alias("term_type"),
        names_of(vocab.BRAND_TYPES).alias("brand_names"),
        F.get(generic, F.lit(0)).alias("generic_name"),
        names_of(vocab.SYNONYM_TYPES).alias("synonyms"),
    )
