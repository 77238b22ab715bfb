"""Token-id files: static range asymmetric numeral coding in interleaved blocks.

A file is a folder of Parquet part files, so that Spark's committer decides
which task's output counts when executors are lost. A row is one segment:
consecutive whole documents with about `segment_tokens` ids, their ids and
sizes, one table of frequencies that all blocks of the segment share, and the
blocks. A block is coded on its own, by `lanes` interleaved coders. Its
checkpoint (the coders' states and the place of its words) and its checksum
stand in the segment's directory, so any block can be decoded without the
others; all blocks of a segment are decoded side by side.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlight.llm.chunks import ChunkEncoder
from pairlight.session import cut, work_folder

SCALE, LANES, BLOCK, SEGMENT = 18, 32, 1 << 15, 1 << 21
_LOW = np.uint64(1 << 32)
SCHEMA = ("part int, seq int, n_tokens bigint, doc_ids array<bigint>, doc_tokens binary, scale int, lanes int, steps int, symbols binary, "
          "freqs binary, states binary, word_counts binary, checksums binary, words binary")


def frequencies(counts: np.ndarray, scale: int) -> np.ndarray:
    """Positive whole numbers with the sum 2**scale, in proportion to `counts` as far as that allows."""
    total = 1 << scale
    freqs = np.maximum(1, counts * total // counts.sum())
    rest = total - int(freqs.sum())
    if rest > 0:
        freqs[counts.argmax()] += rest
    while rest < 0:  # symbols that were raised to one: the largest give back
        give = np.argsort(-freqs, kind="stable")[: min(-rest, int((freqs > 1).sum()))]
        freqs[give] -= 1
        rest += len(give)
    return freqs


def encode_blocks(ids: np.ndarray, lanes: int = LANES, block: int = BLOCK, scale: int = SCALE) -> dict:
    """One segment's ids (at least one) as a table, block directory and words."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    place = np.zeros(len(counts), dtype=np.int64)
    place[symbols] = np.arange(len(symbols))
    index, counts = place[ids], counts[symbols]
    scale = max(scale, int(len(symbols)).bit_length() + 1)
    freqs = frequencies(counts.astype(np.int64), scale)
    steps = -(-min(len(ids), block) // lanes)
    blocks = -(-len(ids) // (steps * lanes))
    # beyond the last id: a symbol that fills the whole range, which leaves a coder as it is
    grid = np.full(blocks * steps * lanes, len(symbols), dtype=np.int64)
    grid[: len(ids)] = index
    grid = grid.reshape(blocks, steps, lanes)
    f = np.append(freqs, 1 << scale).astype(np.uint64)
    c = np.append(np.cumsum(freqs) - freqs, 0).astype(np.uint64)
    shift, top = np.uint64(scale), np.uint64(64 - scale)
    state = np.full((blocks, lanes), _LOW)
    words = np.empty((blocks, steps, lanes), dtype=np.uint32)
    sent = np.empty((blocks, steps, lanes), dtype=bool)
    for t in range(steps - 1, -1, -1):
        s = grid[:, t]
        fs = f[s]
        full = (state >> top) >= fs
        words[:, t], sent[:, t] = state.astype(np.uint32), full
        state = np.where(full, state >> np.uint64(32), state)
        quotient = state // fs
        state = (quotient << shift) + (state - quotient * fs) + c[s]
    kept = words[sent].astype("<u4")  # by block, then in the order in which a decoder asks for them
    sizes = sent.sum(axis=(1, 2))
    ends = np.cumsum(sizes)
    raw, states = kept.tobytes(), state.astype("<u8")
    checks = [zlib.crc32(raw[4 * (e - n) : 4 * e], zlib.crc32(states[i].tobytes())) for i, (e, n) in enumerate(zip(ends, sizes))]
    return {"scale": scale, "lanes": lanes, "steps": steps, "symbols": symbols.astype("<u4").tobytes(), "freqs": freqs.astype("<u4").tobytes(),
            "states": states.tobytes(), "word_counts": sizes.astype("<u4").tobytes(), "checksums": np.array(checks, dtype="<u4").tobytes(), "words": raw}


def decode_blocks(seg: dict, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks `first` to `last` (exclusive; None: all) of a segment. A damaged block raises ValueError."""
    lanes, steps, scale = seg["lanes"], seg["steps"], seg["scale"]
    symbols = np.frombuffer(seg["symbols"], dtype="<u4")
    freqs = np.frombuffer(seg["freqs"], dtype="<u4").astype(np.int64)
    sizes = np.frombuffer(seg["word_counts"], dtype="<u4").astype(np.int64)
    checks = np.frombuffer(seg["checksums"], dtype="<u4")
    states = np.frombuffer(seg["states"], dtype="<u8").reshape(-1, lanes)
    last = len(sizes) if last is None else last
    ends = np.cumsum(sizes)
    base = (ends - sizes)[first:last].copy()
    for i in range(first, last):
        raw = seg["words"][4 * (ends[i] - sizes[i]) : 4 * ends[i]]
        if zlib.crc32(raw, zlib.crc32(states[i].tobytes())) != checks[i]:
            raise ValueError(f"block {i}: checksum differs")
    words = np.append(np.frombuffer(seg["words"], dtype="<u4"), np.uint32(0)).astype(np.uint64)
    of_slot = np.repeat(np.arange(len(symbols)), freqs)
    f_slot = freqs.astype(np.uint64)[of_slot]
    bias = (np.arange(1 << scale) - np.repeat(np.cumsum(freqs) - freqs, freqs)).astype(np.uint64)
    mask, shift = np.uint64((1 << scale) - 1), np.uint64(scale)
    state = states[first:last].copy()
    out = np.empty((last - first, steps, lanes), dtype=np.int32)
    in_block = np.minimum(np.maximum(seg["n_tokens"] - np.arange(first, last) * steps * lanes, 0), steps * lanes)
    for t in range(steps):
        slot = (state & mask).astype(np.int64)
        out[:, t] = of_slot[slot]
        new = f_slot[slot] * (state >> shift) + bias[slot]
        if t * lanes + lanes > in_block[-1]:
            new = np.where(t * lanes + np.arange(lanes)[None, :] < in_block[:, None], new, state)
        low = new < _LOW
        order = np.cumsum(low, axis=1)
        at = np.where(low, base[:, None] + order - 1, len(words) - 1)
        state = np.where(low, (new << np.uint64(32)) | words[at], new)
        base += order[:, -1]
    flat = out.reshape(last - first, -1)
    return symbols[flat.ravel()[: int(in_block.sum())]] if (in_block[:-1] == steps * lanes).all() else np.concatenate([symbols[r[:n]] for r, n in zip(flat, in_block)])


@lru_cache(maxsize=2)
def _encoder(path: str) -> ChunkEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    size = np.zeros(max(tokenizer.get_vocab().values()) + 1, dtype=np.int64)
    for token, i in tokenizer.get_vocab().items():
        size[i] = len(token)  # a byte-level vocabulary writes each byte as one character

    def encode(texts: list[str]) -> list[bytes]:
        """Chunks that open with a blank may stand one after another in one call; where each ends is known from its bytes."""
        out: list[bytes] = []
        for k in range(0, len(texts), 1000):
            some = texts[k : k + 1000]
            lead = [t for t in some if t[:1] == " " and len(t) > 1 and not t[1].isspace()]
            rest = [t for t in some if not (t[:1] == " " and len(t) > 1 and not t[1].isspace())]
            first, *others = tokenizer.encode_batch_fast(["".join(lead), *rest], add_special_tokens=False)
            ids = np.array(first.ids, dtype="<u4")
            ends = np.searchsorted(np.cumsum(size[ids]), np.cumsum([len(t.encode()) for t in lead], dtype=np.int64)) + 1
            raw, at, more = ids.tobytes(), 0, iter(others)
            ends = iter(ends.tolist())
            for t in some:
                if t[:1] == " " and len(t) > 1 and not t[1].isspace():
                    end = next(ends)
                    out.append(raw[4 * at : 4 * end])
                    at = end
                else:
                    out.append(np.array(next(more).ids, dtype="<u4").tobytes())
        return out

    return ChunkEncoder(encode, limit=800_000, group_chars=1 << 19)


@lru_cache(maxsize=2)
def _added(path: str) -> tuple[re.Pattern, Callable[[str], bytes]]:
    """A pattern for texts that hold an added token of the file, and the ids of such a text: the library takes it whole."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokens = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
    return re.compile("|".join(tokens) or r"(?!)"), lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int, segment_tokens: int = SEGMENT, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts with the library's tokenizer file and write a token-id file at `out`.

    Documents stand in ascending doc_id order (null first); documents with the
    same id stand in the order of their texts. Each one ends with `end_id`. Null
    text counts as empty. Added tokens inside a text get their own ids, as in the
    library's encoding of the whole text. Memory is bounded by one segment and the largest document.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    end = np.uint32(end_id).tobytes()

    def run(batches):
        encoder, (added, whole) = _encoder(tokenizer), _added(tokenizer)
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[int, bytes]] = []
        n = 0

        def segment():
            sizes = np.array([len(b) // 4 for _, b in held], dtype="<u4")
            row = encode_blocks(np.frombuffer(b"".join([b for _, b in held]), dtype="<u4")) | {
                "part": part, "seq": seq, "n_tokens": int(sizes.sum(dtype=np.int64)), "doc_ids": [i for i, _ in held], "doc_tokens": sizes.tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in batches:
            texts = batch.column("text").to_pylist()
            apart = {k for k, t in enumerate(texts) if added.search(t)}
            made = encoder.texts("" if k in apart else t for k, t in enumerate(texts))
            for k, (i, ids) in enumerate(zip(batch.column("id").to_pylist(), made, strict=True)):
                if k in apart:
                    ids = whole(texts[k])
                held.append((i, ids + end))
                n += len(ids) // 4 + 1
                if n >= segment_tokens:
                    yield segment()
                    held, n, seq = [], 0, seq + 1
        if held:
            yield segment()

    rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(run, SCHEMA).write.mode("overwrite").parquet(out)


ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.binary()),
                   ("scale", pa.int32()), ("lanes", pa.int32()), ("steps", pa.int32()), *[(k, pa.binary()) for k in ("symbols", "freqs", "states", "word_counts", "checksums", "words")]])


def segment_starts(segments: DataFrame) -> DataFrame:
    """(part, seq, seg_start): ids before each segment. Only totals of parts, one row per writing task, meet in one place."""
    sizes = segments.select("part", "seq", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (sizes.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
            .join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("inner")).alias("seg_start")))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a token-id file: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit integers).

    Checks every block's checksum. An empty file gives no rows.
    """
    segments = spark.read.schema(SCHEMA).parquet(path)

    def run(batches):
        for batch in batches:
            for seg in batch.to_pylist():
                ids = decode_blocks(seg).astype("<u4").tobytes()
                sizes = np.frombuffer(seg["doc_tokens"], dtype="<u4").astype(np.int64)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([pa.array([seg["part"]] * len(sizes), pa.int32()), pa.array([seg["seq"]] * len(sizes), pa.int32()), pa.array(seg["doc_ids"], pa.int64()),
                                                  pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([ids[4 * (e - n) : 4 * e] for e, n in zip(ends, sizes)], pa.binary())],
                                                 names=["part", "seq", "doc_id", "inner", "n_tokens", "ids"])

    decoded = segments.mapInArrow(run, "part int, seq int, doc_id bigint, inner bigint, n_tokens bigint, ids binary")
    return (decoded.join(cut(segment_starts(segments)), ["part", "seq"])
            .select("doc_id", (F.col("seg_start") + F.col("inner")).alias("start"), "n_tokens", "ids"))


def new_file(spark: SparkSession) -> str:
    return f"{work_folder(spark)}/tokens-{uuid.uuid4().hex}"
