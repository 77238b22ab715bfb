"""Vector expressions and the embedding hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlight import vocab
from pairlight.functions.text import let


class Embedder(Protocol):
    """Adds a vector column for a text column."""

    dimension: int

    def __call__(self, df: DataFrame, text: str, out: str) -> DataFrame: ...


def hash_vector(text: Column, dim: int) -> Column:
    """Deterministic vector from the bytes of a SHA-256 digest, repeated to dim, scaled to -1..1."""
    def spread(digest: Column) -> Column:
        byte = lambda i: F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (byte(i) - 127.5) / 127.5)

    return F.when(text.isNotNull(), let(F.sha2(text, 256), spread))


class HashEmbedder:
    """Embedding without a model; keeps plumbing testable and stays in the JVM."""

    def __init__(self, dimension: int = 16):
        self.dimension = dimension

    def __call__(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, hash_vector(F.col(text), self.dimension))


class ModelEmbedder:
    """Embedding by a model that `load` builds once per Python worker.

    `load` returns a function from a list of texts to a list of vectors. It is
    called on the workers, so a model is never sent from the driver. Rows
    without text get no vector and do not reach the model.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], list[list[float]]]], dimension: int, batch: int = 64):
        self.load, self.dimension, self.batch = load, dimension, batch

    def __call__(self, df: DataFrame, text: str, out: str) -> DataFrame:
        load, size, dim = self.load, self.batch, self.dimension

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                vectors = pd.Series([None] * len(texts), index=texts.index, dtype=object)
                asked = texts[texts.notna()]
                for i in range(0, len(asked), size):
                    part = asked.iloc[i:i + size]
                    for at, vector in zip(part.index, model(part.tolist()), strict=True):
                        if len(vector) != dim:
                            raise ValueError(f"model returned a vector that does not have {dim} values")
                        vectors.at[at] = [float(x) for x in vector]
                yield vectors

        return df.withColumn(out, embed(F.col(text)))


#: A tokenizer and an encoder: lists of token ids of texts; (ids, mask) of one width to vectors per token.
TokenModel = tuple[Callable[[list[str]], list[list[int]]], Callable[[np.ndarray, np.ndarray], np.ndarray]]


def pool_tokens(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked means of token vectors (rows, width, dimension), scaled to length one; zeros where no token counts."""
    weight = mask[:, :, None].astype(np.float64)
    mean = (tokens * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)
    return mean / np.maximum(np.sqrt((mean * mean).sum(axis=1, keepdims=True)), 1e-12)


class TokenEmbedder:
    """Embedding by a model that gives a vector per token, with all that stands around it.

    `load` builds the tokenizer and the encoder once per Python worker. Token lists
    are cut after `max_tokens`, sorted by length within an Arrow batch and padded to
    the next of `widths` only, so short texts don't pay for long ones; the encoder
    sees at most `batch` rows at once. Means count unpadded tokens alone and are
    scaled to length one. Null texts get no vector and don't reach the model, texts
    without tokens get zeros.
    """

    def __init__(self, load: Callable[[], TokenModel], dimension: int, batch: int = 64, max_tokens: int = vocab.MAX_TOKENS, widths: tuple[int, ...] = (16, 32, 64, 128)):
        self.load, self.dimension, self.batch, self.max_tokens = load, dimension, batch, max_tokens
        self.widths = np.array(sorted({min(w, max_tokens) for w in widths} | {max_tokens}))

    def embed(self, model: TokenModel, texts: list[str]) -> np.ndarray:
        """Vectors of texts, in their order."""
        tokenize, encode = model
        tokens = [t[: self.max_tokens] for t in tokenize(texts)]
        length = np.array([len(t) for t in tokens], dtype=np.int64)
        width = self.widths[np.searchsorted(self.widths, length)] if len(tokens) else length
        out = np.zeros((len(tokens), self.dimension))
        order = np.argsort(width, kind="stable")
        for w in np.unique(width):
            rows = order[np.searchsorted(width[order], w, "left") : np.searchsorted(width[order], w, "right")]
            for k in range(0, len(rows), self.batch):
                part = rows[k : k + self.batch]
                ids, mask = np.zeros((len(part), w), dtype=np.int64), np.arange(w) < length[part, None]
                ids[mask] = np.concatenate([np.asarray(tokens[i], dtype=np.int64) for i in part])
                vectors = np.asarray(encode(ids, mask), dtype=np.float64)
                if vectors.shape != (len(part), w, self.dimension):
                    raise ValueError(f"the model returned {vectors.shape} for {(len(part), w, self.dimension)}")
                out[part] = pool_tokens(vectors, mask)
        return out

    def __call__(self, df: DataFrame, text: str, out: str) -> DataFrame:
        load, embed = self.load, self.embed

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                asked = np.flatnonzero(texts.notna().to_numpy())
                vectors = np.full(len(texts), None, dtype=object)
                for at, vector in zip(asked, embed(model, texts.iloc[asked].tolist()), strict=True):
                    vectors[at] = vector
                yield pd.Series(vectors, index=texts.index)

        return df.withColumn(out, run(F.col(text)))


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(vec: Column, floor: float = 1e-12) -> Column:
    return let(F.greatest(norm(vec), F.lit(floor)), lambda n: F.transform(vec, lambda x: x.cast("double") / n))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d
    )


def mean_pool(df: DataFrame, key: str, vec: str, mask: str, out: str = "pooled") -> DataFrame:
    """Masked mean of the vectors of each key, one value per dimension.

    Sums are taken per (key, dimension), so a key with very many vectors is
    pre-aggregated in every map task and never gathered as a list.
    """
    parts = (
        df.select(key, F.col(mask).cast("double").alias("_m"), F.posexplode(vec).alias("_i", "_x"))
        .groupBy(key, "_i")
        .agg(F.sum(F.col("_m") * F.col("_x").cast("double")).alias("_s"), F.sum("_m").alias("_n"))
        .select(key, "_i", (F.col("_s") / F.greatest("_n", F.lit(1e-9))).alias("_v"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("_i", "_v")))
    return parts.groupBy(key).agg(F.transform(ordered, lambda p: p["_v"]).alias(out))
