"""Nearest neighbours by inner product from randomly rotated one-bit codes.

A vector is scaled to length one and rotated by a fixed random rotation; its
code is one sign bit per dimension, packed, with two correction scalars: its
length and the inner product of the rotated vector with its code's corner. A
query is rotated too; a slice's bits become signs once, and the inner products
of many queries with all its corners are one matrix product. The estimate has a
known error; only vectors whose upper bound reaches the k-th best exact score
so far are scored exactly on the original vectors.

Every query meets every vector's code: queries are dealt to blocks and vectors
to slices of bounded size, and a task takes one block and one slice and returns
k rows per query. Both sizes are constants; what grows is the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ERROR, BLOCK, SLICE, STEP, SEED = 2.5, 2048, 16384, 64, 7
INDEX = "vec_id bigint, dim int, vector array<float>, code binary, length double, aligned double"


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix from vectors of `dim` to the next multiple of 64."""
    wide = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:dim]


def encode(vectors: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, lengths, and inner products with the codes' corners, of non-zero finite rows."""
    scale = np.abs(vectors).max(axis=1, keepdims=True)  # lengths of huge or tiny vectors stay finite
    length = scale[:, 0] * np.linalg.norm(vectors / scale, axis=1)
    turned = (vectors / length[:, None]) @ rotation(vectors.shape[1], seed)
    return np.packbits(turned > 0, axis=1, bitorder="little"), length, np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def index(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", seed: int = SEED) -> DataFrame:
    """The code table of all usable vectors; null, empty, zero or partly null or non-finite ones, and those without id, take no part."""
    v = F.col("vector")
    usable = (v.isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False))))
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<float>").alias("vector")).where(usable)

    def run(batches):
        for batch in batches:
            dims = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                code, length, aligned = encode(some.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64), seed)
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), pa.array(np.full(len(some), dim, np.int32)), some.column("vector"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length), pa.array(aligned)],
                                                 names=["vec_id", "dim", "vector", "code", "length", "aligned"])

    return rows.mapInArrow(run, INDEX)


def nearest(asked: np.ndarray, skip: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, length: np.ndarray, aligned: np.ndarray, k: int, turn: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of `asked`, the k nearest of one slice but the id in `skip`: ids and exact scores, nearest first, ties to the smaller id. ids ascend."""
    wide = turn.shape[1]
    corners = np.unpackbits(codes, axis=1, bitorder="little").astype(np.float32) * 2 - 1
    factor = length / aligned / np.sqrt(wide)
    bound = length * (np.sqrt(np.maximum(0.0, 1 - aligned**2)) / aligned * ERROR / np.sqrt(max(1, wide - 1)) + 1e-5)
    for at in range(0, len(asked), STEP):
        block = asked[at : at + STEP]
        size = np.linalg.norm(block, axis=1)
        estimate = (((block / size[:, None]) @ turn).astype(np.float32) @ corners.T) * factor
        estimate[ids[None, :] == skip[at : at + STEP, None]] = -np.inf
        n_open = np.isfinite(estimate).sum(axis=1)
        firsts = np.argpartition(-estimate, k - 1, axis=1)[:, :k] if len(ids) > k else None
        upper = estimate + bound
        for i, query in enumerate(block):
            if n_open[i] > k:
                reached = (vectors[firsts[i]].astype(np.float64) @ query).min() / size[i]
                some = np.flatnonzero(upper[i] >= reached - 1e-9 * abs(reached))
                rough = vectors[some].astype(np.float64) @ query
                some = some[rough >= np.partition(rough, -k)[-k] - 1e-12 * size[i] * length[some].max()] if len(some) > k else some
            else:
                some = np.flatnonzero(np.isfinite(estimate[i]))
            score = (vectors[some].astype(np.float64) * query).sum(axis=1)  # equal vectors get equal scores, wherever they stand
            order = np.lexsort((ids[some], -score))[:k]
            yield ids[some][order], score[order]


def search(table: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, slice_rows: int = SLICE, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows of `table` (see `index`) but the row with its own id.

    `queries` has the columns of `table`. Only vectors of a query's own
    dimension are candidates; with fewer than k, all are returned. Ids are
    expected to be unique; rows that repeat an id each count. Tables without
    rows give none.
    """
    n_queries, n_rows = queries.count(), table.count()
    blocks, slices = max(1, -(-n_queries // block)), max(1, -(-n_rows // slice_rows))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.lit(True).alias("asks"), "*", deal(blocks, 1).alias("b"), every(slices).alias("s"))
    right = table.select(F.lit(False).alias("asks"), "*", deal(slices, 2).alias("s"), every(blocks).alias("b"))

    def cell(rows: pa.Table) -> pa.Table:
        asks = rows.column("asks").to_numpy()
        dim = rows.column("dim")[0].as_py()
        matrix = lambda t: t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        here = rows.filter(pa.array(~asks)).sort_by("vec_id")
        ask = rows.filter(pa.array(asks))
        out: list[tuple[int, int, float]] = []
        if len(here) and len(ask):
            ids, vectors = here.column("vec_id").to_numpy(), matrix(here)
            codes = np.frombuffer(b"".join(here.column("code").to_pylist()), dtype=np.uint8).reshape(len(here), -1)
            length, aligned = here.column("length").to_numpy(), here.column("aligned").to_numpy()
            asking = ask.column("vec_id").to_numpy()
            found = nearest(matrix(ask).astype(np.float64), asking, ids, vectors, codes, length, aligned, k, rotation(dim, seed))
            for q, (near, scores) in zip(asking.tolist(), found, strict=True):
                out += zip([q] * len(near), near.tolist(), scores.tolist())
        names = ["query_id", "vec_id", "score"]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else ([], [], []), (pa.int64(), pa.int64(), pa.float64()))], names=names)

    cells = left.unionByName(right).groupBy("dim", "b", "s").applyInArrow(cell, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return cells.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
