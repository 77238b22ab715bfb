"""SimHash near-duplicates, compared bit-sliced.

Fingerprints are made per document in Arrow batches. Equal fingerprints are one
class from then on. Two fingerprints that differ in at most `radius` bits agree
on at least `blocks - radius` of `blocks` stretches of bits, so each class is
dealt to one group per choice of that many stretches, and no link is lost.
Inside a task the sorted groups lie next to each other; their fingerprints are
stored vertically, one bit plane per bit. All distances between each row and
the d-th row after it are counted at once: planes are shifted by d, compared,
and added into carry-save counters; words of 64 pairs that all exceed the
radius are abandoned after each few planes. Groups with more rows than `chunk`
are split into tiles of two parts each, so no task holds a large group. A task
returns links that span what it found connected, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlight.llm.chunks import short_batches
from pairlight.llm.graph import components
from pairlight.session import cut

RADIUS, BLOCKS, CHUNK, BITS = 4, 6, 2048, 64
#: For each byte, its bits as eight 8-bit counters of one word.
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)


def fingerprint(text: str, words: int = 4) -> int:
    """64-bit SimHash of a text: a bit is set if it is set in more than half of the shingles' hashes; 0 without words."""
    parts = text.encode().lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    starts = list(accumulate((len(p) + 1 for p in parts), initial=0))
    ends = starts[words:] if len(parts) >= words else starts[-1:]
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(line[a : b - 1], 42) for a, b in zip(starts, ends)], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(0, len(hashes), 255):  # an 8-bit counter holds 255
        sums = _SPREAD[lanes[k : k + 255]].sum(axis=0, dtype=np.uint64)
        counts += sums.view(np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp): a row for each row of `docs`. A-Z count as a-z, words end at ASCII white space, null text has no words."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for batch in short_batches(batches):
            made = np.array([fingerprint(t or "", words) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes (64, words + 1) of 64-bit numbers; row i is bit i % 64 of word i // 64."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, dtype=np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    return np.concatenate([planes, np.zeros((BITS, 1), dtype=np.uint64)], axis=1)


def close_pairs(fps: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) with i < j < ends[i] whose fingerprints differ in at most `radius` bits; ends: where i's group ends."""
    n = len(fps)
    planes = _planes(fps)
    place = np.arange(n)
    room = ends - place - 1
    depth = int(radius).bit_length()
    order = (np.arange(BITS) * 37) % BITS  # neighbouring bits may share a key's stretch and tell little
    for d in range(1, int(room.max(initial=0)) + 1):
        wanted = np.packbits(np.pad(room >= d, (0, -n % 64)), bitorder="little").view(np.uint64)
        at = np.flatnonzero(wanted)
        if not len(at):
            break
        alive = wanted[at]
        whole, part = d >> 6, np.uint64(d & 63)
        last = planes.shape[1] - 1
        counter = [np.zeros(len(at), dtype=np.uint64) for _ in range(depth)]
        for k, p in enumerate(order):
            plane = planes[p]
            moved = plane[np.minimum(at + whole, last)]
            if part:
                moved = (moved >> part) | (plane[np.minimum(at + whole + 1, last)] << (np.uint64(64) - part))
            carry = plane[at] ^ moved
            for i in range(depth):
                counter[i], carry = counter[i] ^ carry, counter[i] & carry
            alive = alive & ~carry  # the counter ran over: more than the radius for good
            if k % 4 == 3 or k == BITS - 1:
                above, equal = np.zeros_like(alive), ~np.zeros_like(alive)
                for i in range(depth - 1, -1, -1):
                    if radius >> i & 1:
                        equal = equal & counter[i]
                    else:
                        above, equal = above | (equal & counter[i]), equal & ~counter[i]
                alive = alive & ~above
                left = np.flatnonzero(alive)
                if len(left) < len(at):
                    at, alive, counter = at[left], alive[left], [c[left] for c in counter]
                if not len(at):
                    break
        if len(at):
            bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            word, bit = np.nonzero(bits)
            i = at[word] * 64 + bit
            yield i, i + d


class _Forest:
    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[x]
            if (up == x).all():
                return x
            self.root[x] = self.root[up]
            x = self.root[x]

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = self.find(i), self.find(j)
            apart = i != j
            low, high = np.minimum(i, j)[apart], np.maximum(i, j)[apart]
            np.minimum.at(self.root, high, low)
            i, j = low, high


def links_of_groups(batches, radius: int):
    """Spanning links of the groups of an iterator of record batches (g, fp, rep) that is sorted by g."""
    held: list[tuple[np.ndarray, ...]] = []

    def compare(group: np.ndarray, fp: np.ndarray, rep: np.ndarray):
        change = np.flatnonzero(np.diff(group)) + 1
        size = np.diff(np.concatenate([[0], change, [len(group)]]))
        many = np.repeat(size > 1, size)
        group, fp, rep, size = group[many], fp[many], rep[many], size[size > 1]
        if not len(fp):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])
        forest = _Forest(len(fp))
        for i, j in close_pairs(fp, np.repeat(np.cumsum(size), size), radius):
            forest.join(i, j)
        place = np.arange(len(fp))
        root = forest.find(place.copy())
        some = root != place
        return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[root[some]])], names=["a", "b"])

    n = 0
    for batch in batches:
        held.append((batch.column("g").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("rep").to_numpy()))
        n += len(batch)
        if n < 1 << 16:
            continue
        group, fp, rep = (np.concatenate(x) for x in zip(*held))
        edge = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
        if edge:
            yield compare(group[:edge], fp[:edge], rep[:edge])
        held, n = [(group[edge:], fp[edge:], rep[edge:])], len(group) - edge
    if n:
        yield compare(*(np.concatenate(x) for x in zip(*held)))


def links(classes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between classes (fp, rep) whose components are those of all links within `radius` bits."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("radius must be below blocks")
    edge = [round(i * BITS / blocks) for i in range(blocks + 1)]
    mask = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = [F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(sum(mask[i] for i in c))).cast("bigint")).alias("key"))
            for k, c in enumerate(combinations(range(blocks), blocks - radius))]
    dealt = classes.select("fp", "rep", F.explode(F.array(*keys)).alias("k")).select("fp", "rep", "k.t", "k.key")
    heavy = dealt.groupBy("t", "key").count().where(F.col("count") > chunk).select("t", "key", F.ceil(F.col("count") / chunk).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    tiles = F.when(parts == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(own, j) * parts + F.greatest(own, j)))
    # a part of a split group meets itself in every tile that it shares with another part
    tiles = F.when(parts == 1, tiles).otherwise(F.filter(tiles, lambda x: x % (parts + 1) != 0))
    grouped = (dealt.join(heavy, ["t", "key"], "left").select("fp", "rep", "t", "key", F.explode(tiles).alias("tile"))
               .select("fp", "rep", F.xxhash64("t", "key", "tile").alias("g")))
    # two keys may share a hash g: their rows are then compared once more, and only true links are found
    return grouped.repartition("g").sortWithinPartitions("g").select("g", "fp", "rep").mapInArrow(lambda b: links_of_groups(b, radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of `docs` with the smallest doc_id it is linked with, itself included.

    Documents link if their fingerprints differ in at most `radius` bits; texts
    without words all have fingerprint 0 and link. A row without doc_id gets no
    component unless another document has its fingerprint. Repeated rows stay.
    An empty table gives no rows.
    """
    marked = cut(fingerprints(docs, doc_id, text, words))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(classes.where("rep is not null"), radius, blocks))
    roots = classes.join(found, classes.rep == found.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return marked.join(roots, "fp", "left").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """The documents of `docs` that are the first of their group, by doc_id; of rows that repeat a doc_id all stay or go."""
    kept = near_duplicates(docs, **how).where("doc_id is null or doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.doc_id), "left_semi")
