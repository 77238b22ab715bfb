"""Metadata filters and exact scoped top-k vector search."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlight import vocab


def metadata_filter(df: DataFrame, conditions: dict[str, object]) -> DataFrame:
    """Keep rows that meet all conditions: equality, or membership for a list. None means no condition."""
    tests = []
    for name, want in conditions.items():
        if want is None:
            continue
        if isinstance(want, Iterable) and not isinstance(want, str):
            tests.append(F.col(name).isin(list(want)))
        else:
            tests.append(F.col(name) == F.lit(want))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def usable(vector: str):
    """Whether a vector can be searched: not null or empty, no null or non-finite value."""
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def vector_rejects(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, reason) of the rows that a search leaves out."""
    return df.where(~F.coalesce(usable(vector), F.lit(False))).select(key, F.lit("vector missing or not finite").alias("reason"))


def _block_top_k(k: int, digits: int, strip: int = 32):
    """Top k of one block of chunks for each query of one block of queries, by distance and then by id."""

    def matrix(table: pa.Table, name: str) -> np.ndarray:
        flat = table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(table.num_rows, -1)

    def search(queries: pa.Table, chunks: pa.Table) -> pa.Table:
        if queries.num_rows == 0 or chunks.num_rows == 0:
            return pa.table({"query_id": pa.array([], pa.string()), "chunk_id": pa.array([], pa.string()),
                             "distance": pa.array([], pa.float64())})
        # In the order of the ids, so that a stable choice settles equal distances.
        chunks = chunks.take(pc.sort_indices(chunks["chunk_id"]))
        q, c = matrix(queries, "qvec"), matrix(chunks, "cvec")
        square, keep = (c * c).sum(1), min(k, len(c))
        cols, found = np.empty((len(q), keep), dtype=np.int64), np.empty((len(q), keep))
        for i in range(0, len(q), strip):  # a few queries at a time, whatever the block
            part = q[i : i + strip]
            dist = (part * part).sum(1)[:, None] + square[None, :] - 2.0 * (part @ c.T)
            dist = np.round(np.maximum(dist, 0.0), digits) + 0.0
            border = np.partition(dist, keep - 1, axis=1)[:, keep - 1 : keep]
            # Of the chunks at the border only as many are kept as the nearer ones leave room for.
            near, equal = dist < border, dist == border
            room = keep - near.sum(axis=1, keepdims=True)
            at = np.nonzero(near | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= room)))[1].reshape(-1, keep)
            near = np.take_along_axis(dist, at, axis=1)
            order = np.argsort(near, axis=1, kind="stable")
            cols[i : i + strip], found[i : i + strip] = np.take_along_axis(at, order, axis=1), np.take_along_axis(near, order, axis=1)
        return pa.table({
            "query_id": queries["query_id"].combine_chunks().take(pa.array(np.repeat(np.arange(len(q)), keep))),
            "chunk_id": chunks["chunk_id"].combine_chunks().take(pa.array(cols.ravel())),
            "distance": found.ravel(),
        })

    return search


def top_k(
    queries: DataFrame, chunks: DataFrame, k: int = vocab.TOP_K,
    query_block: int = 512, chunk_block: int = 8192, digits: int = 6,
) -> DataFrame:
    """The k nearest chunks of each query among the chunks of the query's scopes, by squared distance.

    queries: query_id string, scope string, qvec (one row per scope of a query)
    chunks:  chunk_id string, scope string, cvec
    Without a scope column on both sides every query searches all chunks.

    Each scope is cut into blocks of queries and blocks of chunks from its row
    counts, so a scope that owns a third of all chunks is spread over as many
    tasks as it needs and no task holds more than one block of each side. A pair
    of blocks gives back only k rows per query; the block winners are then ranked
    once more. The result is exact over all usable vectors of a query's own
    length; `vector_rejects` lists the others.
    """
    queries = queries.where(usable("qvec")).withColumn("_dim", F.size("qvec"))
    chunks = chunks.where(usable("cvec")).withColumn("_dim", F.size("cvec"))
    if "scope" in queries.columns:
        def sized(df: DataFrame, block: int, out: str) -> DataFrame:
            return df.groupBy("scope").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias(out))

        blocks = sized(queries, query_block, "_nq").join(sized(chunks, chunk_block, "_nc"), "scope")
        queries, chunks = queries.join(blocks, "scope"), chunks.join(blocks, "scope")
    else:
        # One scope for all: two counts take the place of a join.
        def whole(df: DataFrame) -> DataFrame:
            return df.withColumns({"scope": F.lit(""), "_nq": F.lit(n_queries), "_nc": F.lit(n_chunks)})

        n_queries = max(1, math.ceil(queries.count() / query_block))
        n_chunks = max(1, math.ceil(chunks.count() / chunk_block))
        queries, chunks = whole(queries), whole(chunks)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (
        queries.withColumn("_qb", F.expr("int(pmod(xxhash64(query_id), _nq))"))
        .select("scope", "_qb", all_of("_nc").alias("_cb"), "_dim", "query_id", "qvec")
    )
    right = (
        chunks.withColumn("_cb", F.expr("int(pmod(xxhash64(chunk_id), _nc))"))
        .select("scope", "_cb", all_of("_nq").alias("_qb"), "_dim", "chunk_id", "cvec")
    )
    keys = ["scope", "_qb", "_cb", "_dim"]
    winners = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _block_top_k(k, digits), "query_id string, chunk_id string, distance double"
    )
    place = W.partitionBy("query_id").orderBy("distance", "chunk_id")
    return winners.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def retrieve(
    queries: DataFrame, index: DataFrame, embedder, k: int = vocab.TOP_K,
    rxcui: object = None, section_key: object = None,
) -> DataFrame:
    """Top k of the index for each (query_id, query_text), optionally within drugs and a section.

    Blank queries give no rows.
    """
    from pairlight.functions.text import strip

    scope = metadata_filter(index, {"rxcui": rxcui, "section_key": section_key})
    asked = embedder(queries.where(strip(F.col("query_text")) != ""), "query_text", "qvec")
    hits = top_k(
        asked.select(F.col("query_id").cast("string").alias("query_id"), "qvec"),
        scope.select("chunk_id", F.col("embedding").alias("cvec")),
        k,
    )
    return hits.join(scope.drop("embedding"), "chunk_id")
