"""A training corpus from raw documents: five filtering and encoding stages, each of them one operator of pairlight.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written and read back before the next one starts. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.llm import bpe, copies, decontaminate, lines, toxicity
from pairlight.llm.queries import learnable, table
from pairlight.session import cut, scratch

#: Share of its words that a document has to keep in the line dedup: less than one word of any text, so only documents
#: left without a word go. All their chunks stand in other documents first; copies with words left are for the next stage.
LEAST_KEPT = 1e-12


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    model = toxicity.train(docs, learnable(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, out="_toxicity").where("_toxicity < 0.5").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without chunks of lines that stand elsewhere first; n_chars is counted anew."""
    made = lines.dedup_lines(docs)
    words = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))
    kept = made.where((F.col("n_removed") == 0) | (words(F.col("text_kept")) >= LEAST_KEPT * words(F.col("text"))))
    new = {"text": F.col("text_kept"), "n_chars": F.coalesce(F.length("text_kept"), F.lit(0)).cast("bigint")}
    return kept.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of the documents that are copies by op2's contract or by a similarity of 0.8 in runs of five words."""
    return copies.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to exactly the text."""
    where = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    made = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), *where)
    exact = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return made.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", to_tokens),
]

#: No SQL for a fitted classifier or a tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark):
            docs = cut(stage(spark, docs, sf_dir), keep=True)
    return docs
