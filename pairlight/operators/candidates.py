"""Label candidates of a drug and the choice among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlight import vocab


def candidate_rows(searches: DataFrame, limit: int = vocab.CANDIDATES_KEPT) -> DataFrame:
    """(query_id, rank, setid, spl_version, title, published_date) from parsed search responses.

    searches: query_id, by_rxcui and by_name, both responses parsed to
    struct<data:array<...>>. Each response is cut to the page size, entries
    without id or title are dropped, and the name search only counts when the id
    search gives nothing.
    """
    def usable(response: str):
        rows = F.slice(F.coalesce(F.col(response)["data"], F.array()), 1, limit)
        return F.filter(rows, lambda r: (F.coalesce(r["setid"], F.lit("")) != "") & (F.coalesce(r["title"], F.lit("")) != ""))

    first = usable("by_rxcui")
    chosen = F.when(F.size(first) > 0, first).otherwise(usable("by_name"))
    return searches.select("query_id", F.posexplode(chosen).alias("_i", "c")).select(
        "query_id", (F.col("_i") + 1).alias("rank"), "c.setid", "c.spl_version", "c.title", "c.published_date"
    )


def best_candidate(candidates: DataFrame, key: str, order: list, hit: str,
                   checked: int = vocab.CANDIDATES_CHECKED) -> DataFrame:
    """Per key: the first of the first `checked` candidates with a hit, else the first one.

    Adds candidates_checked, total_candidates_found and evidence_status. The
    ranked cut is taken before rows move (window group limit) and the totals are
    counted on the map side, so a key with very many candidates costs one small
    row per task.
    """
    place = W.partitionBy(key).orderBy(*order)
    top = candidates.withColumn("_rank", F.row_number().over(place)).where(F.col("_rank") <= checked)
    rest = [c for c in candidates.columns if c not in (key, hit)]
    best = top.groupBy(key).agg(
        F.min_by(F.struct("_rank", hit, *rest), F.struct(~F.col(hit), F.col("_rank"))).alias("_b"),
        F.count("*").cast("int").alias("_n"),
    )
    total = candidates.groupBy(key).agg(F.count("*").cast("int").alias("total_candidates_found"))
    return best.join(total, key).select(
        key, *[F.col(f"_b.{c}").alias(c) for c in rest],
        F.when(F.col(f"_b.{hit}"), F.col("_b._rank")).otherwise(F.col("_n")).alias("candidates_checked"),
        "total_candidates_found",
        F.when(F.col(f"_b.{hit}"), "interaction_evidence_found").otherwise("label_found_no_interaction_section")
        .alias("evidence_status"),
    )
