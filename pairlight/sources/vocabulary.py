"""JSON responses of the drug vocabulary and of label searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Shapes of the responses.
EXACT = "struct<idGroup:struct<name:string,rxnormId:array<string>>>"
PROPERTY = "struct<propConceptGroup:struct<propConcept:array<struct<propName:string,propValue:string>>>>"
RELATED = (
    "struct<allRelatedGroup:struct<rxcui:string,conceptGroup:array<struct<tty:string,"
    "conceptProperties:array<struct<rxcui:string,name:string,tty:string>>>>>>"
)
APPROXIMATE = "struct<approximateGroup:struct<inputTerm:string,candidate:array<struct<rxcui:string,score:string>>>>"
CANDIDATES = (
    "struct<data:array<struct<setid:string,spl_version:string,title:string,published_date:string>>>"
)


def read_responses(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of one response shape from JSON files, one response per line."""
    return spark.read.schema(schema.removeprefix("struct<").removesuffix(">").replace(":", " ", 1)).json(path)


def parse_responses(df: DataFrame, column: str, schema: str, out: str = "response") -> DataFrame:
    return df.withColumn(out, F.from_json(F.col(column), schema))


def exact_id(response: Column) -> Column:
    return F.get(response["idGroup"]["rxnormId"], F.lit(0))


def canonical_name(response: Column) -> Column:
    return F.get(response["propConceptGroup"]["propConcept"], F.lit(0))["propValue"]


def approximate_candidates(response: Column, min_score: float) -> Column:
    """Candidates in given order with an id and a numeric score of at least min_score."""
    scored = F.transform(response["approximateGroup"]["candidate"], lambda c: F.struct(
        c["rxcui"].alias("rxcui"), c["score"].try_cast("double").alias("score")))
    return F.filter(F.coalesce(scored, F.array()), lambda c: (c["rxcui"] != "") & (c["score"] >= min_score))


def related_rows(df: DataFrame, response: str = "response", key: str = "rxcui") -> DataFrame:
    """(key, group_pos, tty, pos, related_rxcui, name); groups without members keep one row."""
    groups = df.select(
        key, F.posexplode_outer(F.col(response)["allRelatedGroup"]["conceptGroup"]).alias("group_pos", "g")
    )
    return groups.select(
        key, "group_pos", F.col("g.tty").alias("tty"),
        F.posexplode_outer("g.conceptProperties").alias("pos", "p"),
    ).select(key, "group_pos", "tty", "pos", F.col("p.rxcui").alias("related_rxcui"), F.col("p.name").alias("name"))
