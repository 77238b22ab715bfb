"""Shards of near equal bytes by a K-d tree over metadata.

Documents of equal text are one group and stay together. Each tree node splits
its groups along the dimension in which they spread widest, where the bytes on
both sides are in the ratio of the leaves on both sides: at the median for an
even count. The median is found exactly, by histograms that Spark sums and that
get finer in each round; ties are broken by the group's digest. Groups heavier
than `giant` of a leaf would upset the balance; there are at most leaves /
giant of them, they are dealt first, to the emptiest leaf each, and the tree
fills up the rest. A group above a whole leaf is dealt by documents instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlight.session import cut

GIANT, DIGIT = 0.02, 10
_KEY_BITS = 60


def _unit(x: Column, low: float | None, high: float | None) -> Column:
    """`x` scaled to 30 bits between the least and greatest value of the table; null is least."""
    if low is None or high is None or not high > low:
        return F.lit(0).cast("bigint")
    return F.coalesce(F.floor((x - low) / (high - low) * ((1 << 30) - 1)).cast("bigint"), F.lit(0).cast("bigint"))


def kd_leaves(groups: DataFrame, dims: list[str], capacity: list[float], digit: int = DIGIT) -> DataFrame:
    """`groups` (with the columns of `dims`, weight and tie, a hash) plus leaf: leaf i gets about capacity[i] of the weight.

    dims hold whole numbers below 2**30. What reaches the driver is a row per
    node and dimension, and 2**digit sums per node and round.
    """
    now = groups.withColumn("leaf", F.lit(0))
    spans = {0: len(capacity)}  # node: the number of leaves it stands for, from its own number on
    while any(n > 1 for n in spans.values()):
        split = {a: n for a, n in spans.items() if n > 1}
        ends = now.where(F.col("leaf").isin(*split)).groupBy("leaf").agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("low", F.min), ("high", F.max))]).collect()
        widest = {r["leaf"]: max(dims, key=lambda d: r[f"high_{d}"] - r[f"low_{d}"]) for r in ends}
        chosen = F.lit(None).cast("bigint")
        for a, d in widest.items():
            chosen = F.when(F.col("leaf") == a, F.col(d) * (1 << 30) + F.pmod(F.col("tie"), F.lit(1 << 30))).otherwise(chosen)
        keyed = now.withColumn("place", chosen)
        total = {r["leaf"]: r["w"] for r in keyed.where("place is not null").groupBy("leaf").agg(F.sum("weight").alias("w")).collect()}
        goal = {}
        for a, n in split.items():
            cap = capacity[a : a + n]
            goal[a] = total.get(a, 0) * (sum(cap[: n // 2]) / sum(cap) if sum(cap) else (n // 2) / n)
        border, below = dict.fromkeys(widest, 0), dict.fromkeys(widest, 0)
        for shift in range(_KEY_BITS - digit, -1, -digit):
            near = F.lit(False)
            for a in widest:
                near = near | ((F.col("leaf") == a) & (F.shiftright("place", shift + digit) == F.lit(border[a] >> (shift + digit))))
            sums: dict[int, list[tuple[int, int]]] = {a: [] for a in widest}
            for r in keyed.where(near).groupBy("leaf", F.shiftright("place", shift).alias("digit")).agg(F.sum("weight").alias("w")).collect():
                sums[r["leaf"]].append((r["digit"], r["w"]))
            for a, found in sums.items():
                last = None
                for d, w in sorted(found):
                    last = d
                    if below[a] + w > goal[a]:
                        break
                    below[a] += w
                else:  # rounding: all fits on the left
                    last = (last or 0) + 1
                border[a] = last << shift
        right = F.lit(False)
        for a, n in split.items():
            if a in border:
                right = right | ((F.col("leaf") == a) & (F.col("place") >= F.lit(border[a])))
        half = F.lit(0)
        for a, n in split.items():
            half = F.when(F.col("leaf") == a, F.lit(n // 2)).otherwise(half)
        now = cut(keyed.withColumn("leaf", F.when(right, F.col("leaf") + half).otherwise(F.col("leaf"))).drop("place"))
        spans = {x: m for a, n in spans.items() for x, m in (((a, n),) if n < 2 else ((a, n // 2), (a + n // 2, n - n // 2)))}
    return now


def kd_shards(docs: DataFrame, target_bytes: int | None = None, leaves: int | None = None, dims: tuple[str, ...] = ("lang", "source", "n_chars"), doc_id: str = "doc_id", text: str = "text", giant: float = GIANT) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): one row per row of `docs`.

    Either the bytes a shard should have or the number of shards is given.
    Dimensions are `dims` as far as `docs` has them (texts by hash, numbers as
    they are, null least) and the size. Slots count from 0 in each shard, by
    doc_id, size and text. Repeated rows are a group and each get a slot. An
    empty table gives no rows.
    """
    have = [d for d in dims if d in docs.columns]
    text_of = lambda d: docs.schema[d].dataType.typeName() in ("string", "boolean")
    value = lambda d: (F.pmod(F.xxhash64(F.col(d)), F.lit(1 << 30)) if text_of(d) else F.col(d).cast("double"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"), F.md5(body).alias("digest"),
                           *[F.when(F.col(d).isNotNull(), value(d).cast("double")).alias(f"x{i}") for i, d in enumerate(have)]))
    xs = [*[f"x{i}" for i in range(len(have))], "size"]
    facts = rows.agg(F.sum("size").alias("total"), *[f(x).alias(f"{n}_{x}") for x in xs for n, f in (("low", F.min), ("high", F.max))]).first()
    total = facts["total"] or 0
    count = leaves or max(1, -(-total // target_bytes))
    ideal = total / count
    grouped = rows.groupBy("digest").agg(F.sum("size").alias("weight"), *[F.min(x).alias(x) for x in xs if x != "size"], F.min("size").alias("size"))
    groups = cut(grouped.select("digest", "weight", F.xxhash64("digest").alias("tie"), *[_unit(F.col(x), facts[f"low_{x}"], facts[f"high_{x}"]).alias(f"d_{x}") for x in xs]))
    giants = groups.where(F.col("weight") > giant * ideal).select("digest", "weight").orderBy(F.desc("weight"), "digest").collect()  # at most count / giant
    room, dealt, torn = [ideal] * count, [], []
    for g in giants:
        if g["weight"] > ideal:
            torn.append(g["digest"])
            continue
        at = max(range(count), key=lambda i: (room[i], -i))
        room[at] -= g["weight"]
        dealt.append((g["digest"], at))
    session = docs.sparkSession
    of_giant = session.createDataFrame([*dealt, *((d, -1) for d in torn)], "digest string, giant_leaf int")
    small = groups.join(F.broadcast(of_giant), "digest", "left_anti")
    single = (rows.join(F.broadcast(of_giant.where("giant_leaf = -1")), "digest")  # groups above a leaf: a unit for each document
              .select(F.concat_ws(":", "digest", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("unit"), F.col("size").alias("weight"),
                      F.xxhash64("digest", "doc_id").alias("tie"), *[_unit(F.col(x), facts[f"low_{x}"], facts[f"high_{x}"]).alias(f"d_{x}") for x in xs])
              .groupBy("unit", "tie").agg(F.sum("weight").alias("weight"), *[F.min(f"d_{x}").alias(f"d_{x}") for x in xs]))
    units = small.withColumnRenamed("digest", "unit").unionByName(single)
    leaf = kd_leaves(units, [f"d_{x}" for x in xs], [max(0.0, r) for r in room]).select("unit", F.col("leaf").alias("shard"))
    where = leaf.unionByName(of_giant.where("giant_leaf >= 0").select(F.col("digest").alias("unit"), F.col("giant_leaf").alias("shard")))
    named = rows.join(F.broadcast(of_giant.where("giant_leaf = -1").select("digest", F.lit(True).alias("torn"))), "digest", "left")
    unit = F.when(F.col("torn"), F.concat_ws(":", "digest", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).otherwise(F.col("digest"))
    placed = cut(named.withColumn("unit", unit).join(where, "unit").select("doc_id", "size", "text_crc32", "digest", "shard"))
    return numbered(placed, ["doc_id", "size", "digest"]).select("doc_id", "size", "text_crc32", "shard", "slot")


def numbered(rows: DataFrame, order: list[str], parts: int = 256) -> DataFrame:
    """`rows` plus slot: 0, 1, ... in each shard by `order`, counted in `parts` stretches of the first column so that no shard is one task."""
    cuts = rows.approxQuantile(order[0], [i / parts for i in range(1, parts)], 0.001) if rows.head(1) else []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>")
    stretch = F.coalesce(F.size(F.filter(bounds, lambda b: b <= F.col(order[0]).cast("double"))), F.lit(-1)) if cuts else F.lit(0)
    dealt = rows.withColumn("stretch", F.when(F.col(order[0]).isNull(), F.lit(-1)).otherwise(stretch))
    sizes = dealt.groupBy("shard", "stretch").count()
    before = Window.partitionBy("shard").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "stretch", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("from"))  # at most `parts` + 1 rows a shard
    inner = F.row_number().over(Window.partitionBy("shard", "stretch").orderBy(*order)) - 1
    return dealt.withColumn("inner", inner).join(starts, ["shard", "stretch"]).withColumn("slot", (F.col("from") + F.col("inner")).cast("bigint"))
