"""A Merkle manifest of a table, made by time-forward processing.

Rows are the leaves of one binary tree per group; the groups' roots are the
leaves of one more tree. Nodes are named by labels (tree, level, place) that
every child has before its parent. A node's digest is a message to its parent,
and the messages wait in a priority queue ordered by label: Spark's shuffle,
sorted by label, is its external part and brings each block of 2**LEVELS
neighbours to one task, where a heap delivers the rest. So a stage climbs LEVELS
levels at once, and the number of stages grows with the logarithm of the rows.
The reversed sweep goes down the same blocks: a block's root gets the proof of
all that stands above it as a message sorted before the block's nodes, and hands
it on, one sibling longer at each level, to the leaves.

A proof is text: for each level L, R or S (sibling on the left, on the right,
none), then the sibling's digest, if any.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlight.session import cut

LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    return max(0, leaves - 1).bit_length()


def climb(first: int, digests: list[str], levels: int) -> dict[tuple[int, int], str]:
    """Digests by label (level, place) of all nodes up to `levels` above neighbours whose first is at `first`."""
    made = {(0, first + i): d for i, d in enumerate(digests)}
    queue = [(1, i >> 1, i, d) for (_, i), d in made.items()] if levels else []  # sorted, hence a heap
    while queue:
        level, at = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, at):
            children.append(heapq.heappop(queue)[3])
        made[level, at] = digest_of(*children)
        if level < levels:
            heapq.heappush(queue, (level + 1, at >> 1, at, made[level, at]))
    return made


def descend(made: dict[tuple[int, int], str], levels: int, place: int, suffix: str) -> dict[int, str]:
    """Proofs by place of the lowest nodes of `made`; `suffix` is the proof of the block's root at (levels, place)."""
    queue, out = [(-levels, -place, suffix)], {}
    while queue:
        level, at, known = heapq.heappop(queue)
        level, at = -level, -at
        if not level:
            out[at] = known
            continue
        left, right = made[level - 1, 2 * at], made.get((level - 1, 2 * at + 1))
        if right is None:
            heapq.heappush(queue, (1 - level, -2 * at, "S" + known))
        else:
            heapq.heappush(queue, (1 - level, -2 * at, f"R{right}{known}"))
            heapq.heappush(queue, (1 - level, -2 * at - 1, f"L{left}{known}"))
    return out


def fold(leaf: str, proof: str) -> str:
    """The root that a leaf and its proof lead to."""
    i = 0
    while i < len(proof):
        side, i = proof[i], i + 1
        other = ""
        if side != "S":
            other, i = proof[i : i + 64], i + 64
        leaf = digest_of(other, leaf) if side == "L" else digest_of(leaf, other)
    return leaf


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of batches sorted by (tree, block), block by block."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["tree"], row["block"]) != (held[0]["tree"], held[0]["block"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _stream(batches, of_block: Callable[[list[dict]], list[dict]], names: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    schema, out = pa.schema(list(names.items())), []
    for block in _blocks(batches):
        out += of_block(block)
        if len(out) >= 4096:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    yield pa.RecordBatch.from_pylist(out, schema)


def _lift(rows: DataFrame, levels: int) -> DataFrame:
    """The next level of nodes, `levels` levels above `rows`, or the roots of trees that are lower."""
    def up(block: list[dict]) -> list[dict]:
        top = min(levels, height(block[0]["total"]))
        made = climb(block[0]["idx"], [r["digest"] for r in block], top)
        at = block[0]["idx"] >> top
        return [{"tree": block[0]["tree"], "idx": at, "total": -(-block[0]["total"] >> top) if top else 1, "digest": made[top, at]}]

    names = {"tree": pa.string(), "idx": pa.int64(), "total": pa.int64(), "digest": pa.string()}
    dealt = rows.select("tree", F.shiftright("idx", levels).alias("block"), "idx", "total", "digest")
    return (dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
            .mapInArrow(lambda b: _stream(b, up, names), "tree string, idx bigint, total bigint, digest string"))


def forest(rows: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Levels of nodes (tree, idx, total, digest): `rows` first, the trees' roots last. The driver sees the largest tree's size only."""
    found = [rows]
    largest = rows.agg(F.max("total")).first()[0] or 0
    while largest > 1:
        found.append(cut(_lift(found[-1], levels)))
        largest = -(-largest >> levels)
    return found


def _down(nodes: DataFrame, tops: DataFrame, levels: int, extra: list[str]) -> DataFrame:
    """(tree, idx, digest, proof, subroot, *extra) of `nodes`, from the proofs (tree, idx, proof, subroot) of their blocks' roots."""
    def sweep(block: list[dict]) -> list[dict]:
        above, own = block[0], block[1:]
        top = min(levels, height(own[0]["total"]))
        made = climb(own[0]["idx"], [r["digest"] for r in own], top)
        proofs = descend(made, top, own[0]["idx"] >> top, above["proof"])
        keep = ("tree", "idx", "digest", *extra)
        return [{c: r[c] for c in keep} | {"proof": proofs[r["idx"]], "subroot": above["subroot"]} for r in own]

    block = F.shiftright("idx", levels).alias("block")
    both = nodes.select("tree", block, F.lit(1).alias("kind"), "idx", "total", "digest", *extra).unionByName(
        tops.select("tree", F.col("idx").alias("block"), F.lit(0).alias("kind"), F.col("idx"), "proof", "subroot"), allowMissingColumns=True)
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    types = {"tree": "string", "idx": "bigint", "digest": "string", **{c: dict(nodes.dtypes)[c] for c in extra}, "proof": "string", "subroot": "string"}
    return (both.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "idx")
            .mapInArrow(lambda b: _stream(b, sweep, {c: kinds[t] for c, t in types.items()}), ", ".join(f"{c} {t}" for c, t in types.items())))


def proofs(found: list[DataFrame], tops: DataFrame, levels: int = LEVELS, extra: tuple[str, ...] = ()) -> DataFrame:
    """Proofs of the first of `found`, from those of the trees' roots."""
    for nodes in reversed(found[1:-1]):
        tops = cut(_down(nodes, tops, levels, []).select("tree", "idx", "proof", "subroot"))
    return _down(found[0], tops, levels, list(extra))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` (tree, ...) with idx, the place in their tree by `order`, and total, the size of the tree.

    Rows are sorted by ranges; only counts per tree and range are added up in a window.
    """
    placed = cut(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    spans = placed.groupBy("tree", part.alias("part")).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    all_before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col("tree").alias("t"), "part", (F.coalesce(F.sum("n").over(all_before), F.lit(0)) - F.col("low")).alias("shift"),
                         F.sum("n").over(Window.partitionBy("tree")).alias("total"))
    on = placed.tree.eqNullSafe(spans.t) & (part == spans.part)
    return placed.join(spans, on).select(*rows.columns, (F.col("at") + F.col("shift")).alias("idx"), "total")


def leaf_digest(values: list[Column]) -> Column:
    """Each value as its UTF-8 byte count, a colon and itself, - for null; all in a row, hashed."""
    said = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*said), 256)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", by: str = "lang", claimed: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified): one row per row of `docs`.

    `claimed` gives expressions for the fields as they are at verification: the
    leaf made of them is folded with the recorded proof, and verified says whether
    the recorded root comes out. Null values count as -, a null group is a group
    of its own, the first one. Rows with one key are ordered by their leaves, rows
    that are equal in all fields have equal leaves at neighbouring places. Other
    columns take no part. An empty table gives no rows.
    """
    value = lambda c: F.col(c)
    now = {f: (claimed or {}).get(f, value(f)) for f in fields}
    leaves = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(by).cast("string").alias("tree"), leaf_digest([value(f) for f in fields]).alias("digest"),
                         leaf_digest(list(now.values())).alias("found"))
    rows = cut(ranked(leaves, ["doc_id", "digest"]))
    trees = forest(rows, levels)
    heads = cut(ranked(trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("digest")), ["name"]))
    above = forest(heads, levels)
    root = above[-1].select("digest").first()
    root = root[0] if root else None
    start = above[-1].select("tree", F.lit(0).cast("bigint").alias("idx"), F.lit("").alias("proof"), F.lit("").alias("subroot"))
    tops = cut(proofs(above, start, levels, ("name",)).select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("idx"), "proof", F.col("digest").alias("subroot")))
    made = proofs(trees, tops, levels, ("doc_id", "found"))

    def folded(batches):
        for batch in batches:
            ends = [fold(*x) for x in zip(batch.column("found").to_pylist(), batch.column("proof").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "digest", "subroot", "proof")], pa.array(ends, pa.string())], names=["doc_id", "leaf", "subroot", "proof", "folded_root"])

    out = made.select("doc_id", "digest", "subroot", "proof", "found").mapInArrow(folded, "doc_id bigint, leaf string, subroot string, proof string, folded_root string")
    return out.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))
