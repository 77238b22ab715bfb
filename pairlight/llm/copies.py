"""Near copies by the Jaccard similarity of word shingles.

Min-hashes of each distinct set of shingles are dealt to bands; sets that share
a band are linked with the band's smallest set, without pairs. What is
connected then is a candidate group, far larger than the truth at times: only
there are sets moved, split into tiles of two parts, and compared exactly.
A pair of similarity s shares a band with chance 1 - (1 - s^ROWS)^BANDS: 0.99985 at 0.8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlight.llm import simhash
from pairlight.llm.chunks import short_batches
from pairlight.llm.graph import components
from pairlight.session import cut

WORDS, LEAST, BANDS, ROWS, CHUNK = 5, 0.8, 48, 8, 256
_TURNS = np.random.default_rng(8).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words, of all words if there are fewer; none without words."""
    parts = text.encode().lower().split()
    runs = {b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else ()
    return np.unique(np.array([xxhash.xxh64_intdigest(r, 7) for r in runs], dtype=np.uint64))


def bands(of: np.ndarray) -> list[int]:
    """A key for each band of a set's min-hashes."""
    least = np.full(len(_TURNS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(of), 512):
        mixed = of[k : k + 512, None] * _TURNS
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), b) - (1 << 63) for b, row in enumerate(least.reshape(BANDS, ROWS))]


def _similar(batches, least: float):
    """Spanning links of similar sets, for batches (g, node, has) sorted by g."""
    def compare(rows):
        rows.sort(key=lambda r: len(r[1]))
        forest, size = simhash._Forest(len(rows)), np.array([len(r[1]) for r in rows])
        out = []
        for j in range(len(rows)):
            start = int(np.searchsorted(size, np.ceil(least * size[j] - 1e-9)))  # smaller sets cannot reach the share
            for i in range(start, j):
                at = forest.find(np.array([i, j]))
                if at[0] == at[1]:
                    continue
                both = len(np.intersect1d(rows[i][1], rows[j][1], assume_unique=True))
                if both >= least * (size[i] + size[j] - both) - 1e-9:
                    forest.join(np.array([i]), np.array([j]))
                    out.append((rows[i][0], rows[j][0]))
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    now, held = None, []
    for batch in batches:
        for g, node, has in zip(batch.column("g").to_pylist(), batch.column("node").to_pylist(), batch.column("has").to_pylist()):
            if g != now and held:
                yield compare(held)
                held = []
            now = g
            held.append((node, np.frombuffer(has, dtype=np.uint64)))
    if held:
        yield compare(held)


def _similar_links(docs: DataFrame, sets: DataFrame, doc_id: str, text: str, words: int, least: float, chunk: int) -> DataFrame:
    """Links (a, b) that connect the sets (node, rep, s, bands) which similarity of `least` or more connects; rep: a document with the set."""
    dealt = sets.select("node", F.posexplode("bands").alias("no", "key"))
    hubs = dealt.groupBy("no", "key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("no", "key", "hub")
    groups = components(dealt.join(hubs, ["no", "key"]).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    parts = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts"))
    n = F.col("parts")
    own = F.pmod(F.xxhash64("node"), n).cast("int")
    # a part meets itself in every tile that it shares with another part
    tiles = F.when(n == 1, F.array(F.lit(0))).otherwise(F.filter(F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.least(own, j) * n + F.greatest(own, j)), lambda x: x % (n + 1) != 0))
    asked = groups.join(parts, "root").select("node", "root", tiles.alias("tiles")).join(sets.select("node", "rep", "s"), "node")
    texts = asked.join(docs.select(F.col(doc_id).cast("bigint").alias("rep"), F.col(text).alias("text")), "rep").select("node", "root", "tiles", "s", "text")

    def made(batches):
        for batch in short_batches(batches):
            of = [shingles(t or "", words).tobytes() for t in batch.column("text").to_pylist()]
            same = pa.array([xxhash.xxh128_digest(x) == s for x, s in zip(of, batch.column("s").to_pylist())])  # rows with one doc_id can have other texts
            out = pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), batch.column("tiles"), pa.array(of, pa.binary())], names=["node", "root", "tiles", "has"])
            yield out.filter(same)

    moved = texts.mapInArrow(made, "node bigint, root bigint, tiles array<int>, has binary").select("node", "has", "root", F.explode("tiles").alias("tile"))
    return (moved.select(F.xxhash64("root", "tile").alias("g"), "node", "has").repartition("g").sortWithinPartitions("g")
            .mapInArrow(lambda b: _similar(b, least), "a bigint, b bigint"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, least: float = LEAST, chunk: int = CHUNK) -> DataFrame:
    """The documents of `docs` that are the first of their group, by doc_id; of rows that repeat a doc_id all stay or go.

    Documents link if the Jaccard similarity of their shingles is `least` or more, or by `simhash.near_duplicates`. Rows without doc_id stay.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")

    def signed(batches):
        for batch in short_batches(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sets = [shingles(t, words) for t in texts]
            prints = np.array([simhash.fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints), pa.array([xxhash.xxh128_digest(x.tobytes()) for x in sets], pa.binary()),
                                              pa.array([bands(x) if len(x) else [] for x in sets], pa.list_(pa.int64()))], names=["doc_id", "fp", "s", "bands"])

    marked = cut(rows.mapInArrow(signed, "doc_id bigint, fp bigint, s binary, bands array<bigint>"))
    classes = cut(marked.groupBy("fp", "s").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))
    by_print = cut(classes.groupBy("fp").agg(F.min("node").alias("rep")))
    by_set = cut(classes.groupBy("s").agg(F.min_by("rep", "node").alias("rep"), F.first("bands").alias("bands"), F.min("node").alias("node")))
    link = lambda a, b: (F.col(a).alias("a"), F.col(b).alias("b"))
    links = (simhash.links(by_print).unionByName(_similar_links(docs, by_set, doc_id, text, words, least, chunk))
             .unionByName(classes.select("fp", "node").join(by_print, "fp").select(*link("node", "rep")))
             .unionByName(classes.select("s", "node").join(by_set.select("s", F.col("node").alias("first")), "s").select(*link("node", "first"))))
    found = components(links)
    rooted = cut(classes.select("fp", "s", "rep", "node").join(found, "node", "left").select("fp", "s", "rep", F.coalesce("root", "node").alias("root")))
    first = rooted.groupBy("root").agg(F.min("rep").alias("first"))
    # the first document of a group is the least of the class that holds it
    kept = rooted.join(first, "root").where("rep = first").select(F.col("rep").alias("kept")).distinct()
    return docs.join(kept, docs[doc_id].cast("bigint") == kept.kept, "left_semi").unionByName(docs.where(F.col(doc_id).isNull()))
