"""Similarity join of texts by the Jaccard similarity of their sets of word shingles.

The sets are the rows of a sparse matrix, documents by n-grams; overlaps are the
products of its rows, and are never computed as a whole. Equal sets become one
row. Sorted from rare to common n-grams, two rows that link share one of the
first n - ceil(0.9 n) + 1 of each, so the product starts from these columns
alone, as postings (column, row, size, place). A pair that meets in a column is
dropped at once if sizes and places leave room for too small an overlap only, and
then if its rows differ too often in which blocks of columns hold an odd number of
their members: each such block has a member that only one of them has. The number
of blocks follows the size of a set, so that long texts are told apart as well.

Two products of blocks follow. First, each column and size band has a hub, and
every row meets the hubs of its own band and the next one. The hub is the first
row in one of HUBS orders, so that a family has several and a bad one is made up
for. That joins families of copies by stars. Second, only columns whose rows are
still in several components are looked at, and only pairs of different
components that pass the bounds are multiplied. Rows of one component need no
further link, so pairs within a family are never made. Both times rows are dealt
to blocks, and a task multiplies two blocks, pair by pair of those that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlight.llm.chunks import short_batches
from pairlight.llm.graph import components
from pairlight.session import cut

WORDS, PERCENT, BITS, TILE, HUBS = 3, 90, 18, 512, 8
_WORD_LIMIT = 1 << 18


class _Hashes(dict):
    """64-bit hashes of words, remembered for a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        made = xxhash.xxh64_intdigest(word)
        if len(self) < _WORD_LIMIT:
            self[word] = made
        return made


def shingle_set(text: str | None, words: int, known: dict) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words, of all words if there are fewer; none without words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    of = np.fromiter(map(known.__getitem__, parts), dtype=np.uint64, count=len(parts))
    size = min(words, len(parts))
    n = len(parts) - size + 1
    made = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        made = (made ^ of[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        made ^= made >> np.uint64(29)
        made *= np.uint64(0xBF58476D1CE4E5B9)
        made ^= made >> np.uint64(32)
    return np.unique(made)


def least_overlap(a, b, percent: int = PERCENT):
    """Smallest intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def first_places(n: int, percent: int = PERCENT) -> int:
    """Rarest members of a set of size n of which every linked set shares at least one."""
    return n + percent * -n // 100 + 1 if n else 0


def _loads(batches: Iterator[pa.RecordBatch], words: int, bits: int) -> Iterator[pa.RecordBatch]:
    """How many shingles of a task fall in each of 2**bits bins."""
    known, counts = _Hashes(), np.zeros(1 << bits, dtype=np.int64)
    for batch in short_batches(batches):
        for text in batch.column("text").to_pylist():
            at, n = np.unique(shingle_set(text, words, known) >> np.uint64(64 - bits), return_counts=True)
            counts[at.astype(np.int64)] += n
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bin", "n"])


def commonness(rows: DataFrame, words: int, bits: int) -> np.ndarray:
    """A small number for each bin of shingle hashes, larger for bins that hold far more shingles than others.

    It only orders the columns, from rare to common; any order is right. The driver gets 2**bits numbers, whatever the input.
    """
    total = np.zeros(1 << bits, dtype=np.int64)
    for r in rows.mapInArrow(lambda b: _loads(b, words, bits), "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toArrow().to_batches():
        total[r.column("bin").to_numpy()] = r.column("n").to_numpy()
    usual = max(1.0, float(np.median(total)))
    return np.floor(4 * np.log2(np.maximum(total / (1.5 * usual), 1))).astype(np.uint8)


def _signed(batches: Iterator[pa.RecordBatch], words: int, percent: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, n, digest, firsts, odd, fine): size and digest of each text's set, its rarest members in order, its odd ones among few blocks and among more."""
    known, shift = _Hashes(), np.uint64(64 - int(len(common)).bit_length() + 1)
    for batch in short_batches(batches):
        sizes, digests, firsts, odd, fine = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            has = shingle_set(text, words, known)
            order = np.lexsort((has, common[(has >> shift).astype(np.int64)]))[: first_places(len(has), percent)]
            sizes.append(len(has))
            digests.append(xxhash.xxh128_digest(has.tobytes()))
            firsts.append(has[order].view(np.int64))
            odd.append(odd_blocks(has, few_blocks(len(has))))
            fine.append(odd_blocks(has, fine_blocks(len(has))))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(firsts, pa.list_(pa.int64())), pa.array(odd, pa.binary()),
                                          pa.array(fine, pa.binary())], names=["doc_id", "key", "n", "digest", "firsts", "odd", "fine"])


def fine_blocks(n: int) -> int:
    """Blocks of columns, a power of two from 512 on: more than a set of size n has members."""
    return 1 << max(9, int(n).bit_length())


def few_blocks(n: int) -> int:
    """Half as many, 256 at least, for sizes from 4096 on a quarter, as each of a set's rarest members brings them along."""
    bits = int(n).bit_length()
    return 1 << max(8, min(bits - 1, max(11, bits - 2)))


def odd_blocks(has: np.ndarray, blocks: int) -> bytes:
    """A bit for each block of columns, set if it holds an odd number of a set's members."""
    held = np.bincount((has % np.uint64(blocks)).astype(np.int64), minlength=blocks)
    return np.packbits((held & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(odd: np.ndarray, words: int) -> np.ndarray:
    """The odd ones (rows of 64-bit words) of fewer blocks, of which each takes in those with its number modulo their number."""
    return np.bitwise_xor.reduce(odd.reshape(len(odd), -1, words), axis=1)


def least_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Members that one of two sets has alone, at least, from their odd blocks, row by row."""
    words = min(a.shape[1], b.shape[1])
    return np.bitwise_count(folded(a, words) ^ folded(b, words)).sum(axis=1, dtype=np.int64)


def most_apart(a, b, percent: int = PERCENT):
    """Members that one of two linked sets of sizes a and b has alone, at most."""
    return a + b - 2 * least_overlap(a, b, percent)


class _Odd:
    """The odd blocks of many sets, in a matrix per number of blocks."""

    def __init__(self, odd: list[bytes]):
        self.words = np.fromiter(map(len, odd), dtype=np.int64, count=len(odd)) // 8
        self.place, self.of = np.zeros(len(odd), dtype=np.int64), {}
        for w in np.unique(self.words).tolist():
            some = np.flatnonzero(self.words == w)
            self.place[some] = np.arange(len(some))
            self.of[w] = np.frombuffer(b"".join(odd[k] for k in some.tolist()), dtype="<u8").reshape(-1, w)

    def least_apart(self, i: np.ndarray, other: _Odd, j: np.ndarray) -> np.ndarray:
        """least_apart of the sets i and the sets j of `other`, pair by pair."""
        least = np.zeros(len(i), dtype=np.int64)
        kind = self.words[i] << 32 | other.words[j]
        for k in np.unique(kind).tolist():
            some = np.flatnonzero(kind == k)
            a, b = self.of[k >> 32], other.of[k & (1 << 32) - 1]
            for at in range(0, len(some), 4096):  # a stretch of pairs is copied at once
                part = some[at : at + 4096]
                least[part] = least_apart(a[self.place[i[part]]], b[other.place[j[part]]])
        return least


def _roomy(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs (hub, node) whose odd blocks, the finer ones, leave room for a link."""
    for batch in short_batches(batches, 1 << 12):
        n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
        one, other = (_Odd(batch.column(c).to_pylist()) for c in ("fine", "others"))
        at = np.arange(len(batch))
        yield batch.select(["hub", "node"]).filter(pa.array(one.least_apart(at, other, at) <= most_apart(n, m, percent)))


def _possible(a: Column, b: Column, i: Column, j: Column, percent: int) -> Column:
    """Whether sets of sizes a and b that share the member at places i and j can link."""
    need = F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))
    return F.least(i, j) + F.least(a - i, b - j) >= need


def _tile_products(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Linked pairs (a, b), for batches (tile, role, a, b, has) sorted by tile, role and a; a tile's sets come before its pairs.

    The rows that meet a row are one sparse matrix: its entries are looked up in the row, the hits are added up per line.
    """
    def product(vector: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        ends = np.cumsum([len(x) for x in rows])
        entries = np.concatenate(rows)
        at = np.searchsorted(vector, entries)
        hits = np.concatenate([[0], np.cumsum(vector[np.minimum(at, len(vector) - 1)] == entries)])
        size = np.diff(ends, prepend=0)
        return np.diff(hits[ends], prepend=0) >= least_overlap(size + len(vector), 0, percent)

    def linked(a: int, others: list[int], sets: dict[int, np.ndarray]) -> Iterator[int]:
        for k in range(0, len(others), 256):  # a block of lines
            part = others[k : k + 256]
            yield from (b for b, good in zip(part, product(sets[a], [sets[b] for b in part]), strict=True) if good)

    now, sets, one, others = None, {}, None, []
    for batch in batches:
        out = []
        for tile, role, a, b, has in zip(*(batch.column(c).to_pylist() for c in ("tile", "role", "a", "b", "has")), strict=True):
            if others and (tile != now or role == 0 or a != one):
                out += [(one, x) for x in linked(one, others, sets)]
                others = []
            if tile != now:
                now, sets = tile, {}
            if role == 0:
                sets[a] = np.frombuffer(has, dtype=np.uint64)
            else:
                one = a
                others.append(b)
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
    if others:
        out = list(linked(one, others, sets))
        yield pa.RecordBatch.from_arrays([pa.array([one] * len(out), pa.int64()), pa.array(out, pa.int64())], names=["a", "b"])


def _marked(id: Column, wanted: DataFrame) -> Column:
    """Whether an id may be among `wanted`, by a map of 2**20 bits that the driver hands to all tasks, whatever the input.

    It keeps most texts that no pair needs from being shuffled; a map that is full lets all of them pass.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 20))
    bits = np.zeros(1 << 20, dtype=bool)
    bits[wanted.select(place(F.col(wanted.columns[0])).alias("at")).distinct().toArrow().column("at").to_numpy()] = True
    # as a table of one row: a constant would stand in the text of every plan, and the driver keeps those
    packed = wanted.sparkSession.createDataFrame([(bytearray(np.packbits(bits, bitorder="little").tobytes()),)], "bits binary").scalar()
    byte = F.conv(F.hex(F.substr(packed, F.shiftright(place(id), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte.cast("bigint"), place(id).bitwiseAND(F.lit(7)).cast("int")) == 1


def _multiplied(pairs: DataFrame, classes: DataFrame, rows: DataFrame, words: int, percent: int, tile: int) -> DataFrame:
    """The linked ones of candidate pairs (hub, node).

    Rows are dealt to blocks with the least row that they meet, large blocks in parts of about `tile` rows and 2**20
    entries; a tile is a pair of blocks. So a set is sent once to each tile that it has pairs in, however many they are.
    """
    both = pairs.select(F.col("hub").alias("x"), F.col("node").alias("y")).unionByName(pairs.select(F.col("node").alias("x"), F.col("hub").alias("y")))
    homes = cut(both.groupBy("x").agg(F.min(F.least("x", "y")).alias("home")).join(classes.select(F.col("node").alias("x"), "n", "key", "digest"), "x"))
    sizes = homes.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(F.sum("n") / (1 << 20))).alias("parts"))
    blocks = homes.join(sizes, "home").select("x", F.xxhash64("home", F.pmod(F.xxhash64("x"), "parts")).alias("block"))
    of = lambda end, name: blocks.select(F.col("x").alias(end), F.col("block").alias(name))
    dealt = cut(pairs.join(of("hub", "p"), "hub").join(of("node", "q"), "node").select(F.xxhash64(F.least("p", "q"), F.greatest("p", "q")).alias("tile"), F.col("hub").alias("a"), F.col("node").alias("b")))

    def made(batches):
        known = _Hashes()
        for batch in short_batches(batches):
            of = [shingle_set(t, words, known).tobytes() for t in batch.column("text").to_pylist()]
            same = pa.array([xxhash.xxh128_digest(x) == d for x, d in zip(of, batch.column("digest").to_pylist())])  # rows with one doc_id can have other texts
            yield pa.RecordBatch.from_arrays([batch.column("x"), pa.array(of, pa.binary())], names=["a", "has"]).filter(same)

    texts = rows.where(_marked(F.col("key"), homes.select("key")))
    texts = texts.where("doc_id is not null").unionByName(texts.where("doc_id is null").dropDuplicates(["key", "text"])).drop("doc_id")
    sets = homes.join(texts, "key").select("x", "digest", "text").mapInArrow(made, "a bigint, has binary")
    wanted = dealt.select("tile", "a").distinct().unionByName(dealt.select("tile", F.col("b").alias("a")).distinct()).distinct()
    given = wanted.join(sets, "a").select("tile", F.lit(0).alias("role"), "a", F.lit(None).cast("bigint").alias("b"), "has")
    met = given.unionByName(dealt.select("tile", F.lit(1).alias("role"), "a", "b", F.lit(None).cast("binary").alias("has")))
    return cut(met.repartition("tile").sortWithinPartitions("tile", "role", "a").mapInArrow(lambda b: _tile_products(b, percent), "a bigint, b bigint"))


def _apart(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (hub, node) of rows of different components that can link, for batches (g, node, n, pos, root, before, odd) sorted by g.

    Rows with one column before this one met there as well: the bounds of linked pairs hold in all their columns.
    """
    def pairs(g: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray, before: np.ndarray, odd: np.ndarray) -> Iterator[pa.RecordBatch]:
        """All groups at once: each row with the d-th row after it, as long as some group has one whose size can do."""
        order = np.lexsort((n, g))
        g, node, n, pos, root, before, odd = (x[order] for x in (g, node, n, pos, root, before, odd))
        blocks = _Odd(odd.tolist())
        last = n * 100 // percent  # larger ones cannot link
        at, d = np.arange(len(g)), 0
        while len(at):
            d += 1
            at = at[at + d < len(g)]
            to = at + d
            near = (g[to] == g[at]) & (n[to] <= last[at])
            at, to = at[near], to[near]
            need = least_overlap(n[at], n[to], percent)
            met = (before[at] == before[to]) & (pos[at] > 1) & (pos[to] > 1)
            can = (root[at] != root[to]) & ~met & (np.minimum(pos[at], pos[to]) + np.minimum(n[at] - pos[at], n[to] - pos[to]) >= need)
            i, j = at[can], to[can]
            fits = blocks.least_apart(i, blocks, j) <= n[i] + n[j] - 2 * need[can]
            if fits.any():
                i, j = i[fits], j[fits]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["hub", "node"])

    held: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for batch in batches:
        held.append((*(batch.column(c).to_numpy() for c in ("g", "node", "n", "pos", "root", "before")), batch.column("odd").to_numpy(zero_copy_only=False)))
        rows += len(batch)
        if rows < 1 << 15:
            continue
        whole = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        edge = int(np.searchsorted(whole[0], whole[0][-1]))  # the last group may go on in the next batch
        if edge:
            yield from pairs(*(x[:edge] for x in whole))
        held, rows = [tuple(x[edge:] for x in whole)], len(whole[0]) - edge
    if rows:
        yield from pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): one row per row of `docs`.

    A-Z count as a-z, words end at ASCII white space. Texts link if `percent` times
    the size of the union is at most 100 times that of the intersection of their
    sets; a text without words links with nothing and is its own component.
    component_id is the smallest doc_id that links reach; n_links counts the links
    between different sets that were needed to find it. Rows without doc_id link like
    any other; their component_id is null if no row that they reach has a doc_id.
    Repeated rows stay, no rows give none.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))  # the key finds a text again
    common = commonness(rows.select("text"), words, bits)
    marked = cut(rows.mapInArrow(lambda b: _signed(b, words, percent, common), "doc_id bigint, key bigint, n bigint, digest binary, firsts array<bigint>, odd binary, fine binary"))
    classes = cut(marked.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.coalesce(F.min("doc_id"), F.min("key")).alias("key"), F.first("n").alias("n"), F.first("firsts").alias("firsts"), F.first("odd").alias("odd"), F.first("fine").alias("fine"))
                  .withColumn("node", F.monotonically_increasing_id()))
    postings = classes.select("node", "n", "firsts", F.posexplode("firsts").alias("pos", "col")).select("node", "n", (F.col("pos") + 1).alias("pos"), "col", F.coalesce(F.get("firsts", F.col("pos") - 1), F.lit(0)).alias("before"))
    several = postings.groupBy("col").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("int")
    shared = cut(postings.join(several, "col").withColumn("band", band))
    turn = F.struct(F.xxhash64("node", F.pmod("col", F.lit(HUBS))), "node")
    hubs = shared.groupBy("col", "band").agg(F.min_by(F.struct("n", "node", "pos"), turn).alias("hub"))
    both = shared.select("col", "node", "n", "pos", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    met = both.join(hubs, ["col", "band"]).where(F.col("node") != F.col("hub.node")).where(_possible(F.col("n"), F.col("hub.n"), F.col("pos"), F.col("hub.pos"), percent))
    profile = classes.select("node", "n", "fine")

    def roomy(pairs: DataFrame) -> DataFrame:
        """Pairs (hub, node) that pass the bound of the finer blocks."""
        sized = pairs.join(profile, "node").join(profile.select(F.col("node").alias("hub"), F.col("n").alias("m"), F.col("fine").alias("others")), "hub")
        return cut(sized.select("hub", "node", "n", "m", "fine", "others").mapInArrow(lambda b: _roomy(b, percent), "hub bigint, node bigint"))

    stars = roomy(met.select(F.least("hub.node", "node").alias("hub"), F.greatest("hub.node", "node").alias("node")).distinct())
    links = _multiplied(stars, classes, rows, words, percent, tile)
    joined = components(links)
    placed = shared.select("col", "node", "n", "pos", "before").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("col").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("f")).where("low < high").select("col", F.ceil(F.col("f") / tile).cast("int").alias("parts"))
    own, parts = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.col("parts")
    # a part meets itself in every tile that it shares with another part
    tiles = F.when(parts == 1, F.array(F.lit(0))).otherwise(F.filter(F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(own, j) * parts + F.greatest(own, j)), lambda x: x % (parts + 1) != 0))
    tiled = (placed.join(mixed, "col").select(F.explode(tiles).alias("tile"), "col", "node", "n", "pos", "root", "before")
             .select(F.xxhash64("col", "tile").alias("g"), "node", "n", "pos", "root", "before").join(classes.select("node", "odd"), "node"))
    rest = roomy(tiled.repartition("g").sortWithinPartitions("g").mapInArrow(lambda b: _apart(b, percent), "hub bigint, node bigint").distinct().join(stars, ["hub", "node"], "left_anti"))
    links = links.unionByName(_multiplied(rest, classes, rows, words, percent, tile))
    found = components(links)
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    rooted = cut(classes.select("digest", "rep", "node").join(found, "node", "left").join(ends, "node", "left").withColumn("root", F.coalesce("root", "node")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("digest", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = marked.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.coalesce(alone, "component_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
