"""Byte-level BPE encoding and decoding with padded numpy matrices.

Distinct matches of the split pattern are laid into matrices by length (one
width per bucket, padded). In each round every row merges its leftmost pair of
least rank, is compacted by one column, and looks up the two pairs that the
merge made; rows without a pair leave the matrix. Pairs are found in an
open-addressing hash table held in two arrays. A task keeps one matrix set for
new strings only; see `chunks`.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlight.llm.chunks import ChunkEncoder, short_batches

NONE = np.int32(np.iinfo(np.int32).max)
WIDTHS = (4, 8, 16, 32, 64, 128, 256, 512)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ROWS = 1 << 15


class PairTable:
    """(left id, right id) -> id of the merged token, by open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (np.array(x, dtype=np.uint64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.uint64),) * 3
        bits = max(4, int(2 * len(rank)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << bits, NONE)
        keys, at, todo = (left << np.uint64(32)) | right, None, np.arange(len(rank))
        at = self._home(keys)
        while len(todo):
            free = todo[self.keys[at[todo]] == np.uint64(2**64 - 1)]
            _, first = np.unique(at[free], return_index=True)  # one key for each free cell
            won = free[first]
            self.keys[at[won]], self.ranks[at[won]] = keys[won], rank[won].astype(np.int32)
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], NONE)
        todo = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (found != np.uint64(2**64 - 1))]
        return out


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, piece_limit: int = 100_000):
        self.ranks, self.pairs, self.find = ranks, PairTable(ranks), regex.compile(pattern).findall
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no rank for the bytes {missing[:5]}")
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.whole = {t: np.uint32(r).tobytes() for t, r in ranks.items()}
        self.pieces: dict[bytes, bytes] = {}
        self.piece_limit = piece_limit
        self.chunks = ChunkEncoder(self.encode_chunks)

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        split = [[m.encode() for m in self.find(c)] for c in chunks]
        whole = self.whole
        here = {p: whole[p] if p in whole else self.pieces.get(p) for c in split for p in c}
        new = [p for p, ids in here.items() if ids is None]
        if new:
            made = dict(zip(new, self.merge(new)))
            here |= made
            if len(self.pieces) > self.piece_limit:
                self.pieces.clear()
            self.pieces |= made
        return [b"".join([here[p] for p in c]) for c in split]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each string of bytes, as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        for low, width in zip((0, *WIDTHS), WIDTHS):
            rows = np.flatnonzero((size > low) & (size <= width))
            step = max(1, min(_ROWS, (1 << 20) // width))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                self._matrix([pieces[i] for i in part], size[part], width, part, out)
        for i in np.flatnonzero(size > WIDTHS[-1]):
            out[i] = self._long(pieces[i])
        return out

    def _matrix(self, pieces: list[bytes], size: np.ndarray, width: int, into: np.ndarray, out: list[bytes]) -> None:
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), dtype=np.uint8).reshape(-1, width)
        ids, size = self.byte_ids[raw], size.copy()
        columns = np.arange(width)
        rank = np.full((len(pieces), width), NONE)
        inside = columns[None, : width - 1] < size[:, None] - 1
        rank[:, : width - 1][inside] = self.pairs.look_up(ids[:, :-1][inside], ids[:, 1:][inside])
        while len(ids):
            at = rank.argmin(axis=1)
            row = np.arange(len(ids))
            least = rank[row, at]
            over = least == NONE
            if over.any():
                done = np.flatnonzero(over)
                flat = ids[done].astype("<u4").tobytes()
                for n, i in enumerate(done):
                    out[into[i]] = flat[4 * width * n : 4 * (width * n + size[i])]
                left = ~over
                ids, rank, size, into, at, least = ids[left], rank[left], size[left], into[left], at[left], least[left]
                row = np.arange(len(ids))
                if not len(ids):
                    break
            source = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), width - 1)
            ids[row, at] = least
            ids = np.take_along_axis(ids, source, axis=1)
            rank = np.take_along_axis(rank, source, axis=1)
            rank[:, -1] = NONE
            size -= 1
            rank[row, at] = NONE
            for shift, some in ((0, at < size - 1), (-1, at > 0)):
                r, c = row[some], at[some] + shift
                rank[r, c] = self.pairs.look_up(ids[r, c], ids[r, c + 1])

    def _long(self, piece: bytes) -> bytes:
        """One row wider than all buckets: the same rounds, with the least pair taken from a heap."""
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)]
        n = len(ids)
        first = self.pairs.look_up(ids[:-1], ids[1:]).tolist()
        ids, after, before, stamp = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), first + [int(NONE)]
        heap = [(r, i) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        merged: dict[tuple[int, int], int] = {}

        def rank_of(a: int, b: int) -> int:
            if (a, b) not in merged:
                merged[a, b] = int(self.pairs.look_up(np.array([a]), np.array([b]))[0])
            return merged[a, b]

        while heap:
            r, i = heapq.heappop(heap)
            if stamp[i] != r:
                continue
            j = after[i]
            ids[i], after[i] = r, after[j]
            stamp[j] = -1
            ids[j] = -1
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    stamp[k] = rank_of(ids[k], ids[after[k]]) if after[k] < n else int(NONE)
                    if stamp[k] != NONE:
                        heapq.heappush(heap, (stamp[k], k))
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()

    def encode(self, texts) -> Iterator[np.ndarray]:
        for ids in self.chunks.texts(texts):
            yield np.frombuffer(ids, dtype="<u4")


class Vocabulary:
    """The bytes of all ids in one array."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = sorted(ranks.items(), key=lambda x: x[1])
        self.first = np.zeros(by_id[-1][1] + 2, dtype=np.int64)
        size = np.zeros(by_id[-1][1] + 1, dtype=np.int64)
        for token, r in by_id:
            size[r] = len(token)
        np.cumsum(size, out=self.first[1:])
        self.bytes = np.frombuffer(b"".join(t for t, _ in by_id), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        start = self.first[ids]
        size = self.first[ids + 1] - start
        begun = np.cumsum(size) - size
        return self.bytes[np.repeat(start - begun, size) + np.arange(int(size.sum()))].tobytes()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Bpe:
    return Bpe(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`encode` and `decode` in one pass of one Python worker: `docs` with the ids and the bytes decoded from these ids."""
    kept = docs.drop(ids, out)
    schema = kept.withColumn(ids, F.lit(None).cast("array<int>")).withColumn(out, F.lit(None).cast("binary")).schema

    def run(batches):
        bpe, known = load(path, pattern), vocabulary(path)
        for batch in short_batches(batches):
            made = list(bpe.encode(t or "" for t in batch.column(text).to_pylist()))
            back = pa.array([known.decode(x.astype(np.int64)) for x in made], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(made), back], names=[*batch.schema.names, ids, out])

    return kept.mapInArrow(run, schema)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with the column `ids` (array of int): the whole text by the ranks in the file `path`.

    The vocabulary file has to be on every machine, as the library's files are.
    Each match of `pattern` is encoded separately, special strings are ordinary
    text. Null text counts as empty and has no ids; a column that already has
    the name `ids` is replaced; repeated rows and other columns stay as they are.
    """
    kept = docs.drop(ids)
    schema = kept.withColumn(ids, F.lit(None).cast("array<int>")).schema

    def run(batches):
        bpe = load(path, pattern)
        for batch in short_batches(batches):
            made = list(bpe.encode(t or "" for t in batch.column(text).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(made)], names=[*batch.schema.names, ids])

    return kept.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`docs` with the column `out` (binary): the bytes its ids stand for. Null ids give no bytes."""
    kept = docs.drop(out)
    schema = kept.withColumn(out, F.lit(None).cast("binary")).schema

    def run(batches):
        known = vocabulary(path)
        for batch in short_batches(batches):
            rows = batch.column(ids)
            flat, at = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64), 0
            made = []
            for n in rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False):
                made.append(known.decode(flat[at : at + n]))
                at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, schema)
