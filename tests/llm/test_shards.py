"""Shards: near equal bytes, whole groups, gapless slots."""

import random
import zlib
from collections import Counter, defaultdict

from pairlight.llm import queries, shards


def check(rows, texts, count, slack):
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in texts)
    sums, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        sums[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(sums) <= set(range(count))
    ideal = sum(sums.values()) / count
    assert max(abs(sums[i] - ideal) for i in range(count)) <= slack * ideal, sums
    by = defaultdict(set)
    for d, t in texts:
        by[d].add(t)
    for r in rows:
        assert (r["size"], r.text_crc32) in {(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in by[r.doc_id]}
        where[(r["size"], r.text_crc32)].add(r.shard)
    return where


def test_small_tables(spark):
    rnd = random.Random(1)
    texts = [(i, "é" * rnd.randint(0, 60)) for i in range(3000)] + [(3000 + i, "same text") for i in range(300)] + [(5000, None), (5001, ""), (5002, ""), (5003, "x" * 900), (5003, "x" * 900), (None, "no id")]
    docs = spark.createDataFrame([(d, t, rnd.choice(["en", "fr", None]), "s", 1) for d, t in texts], "doc_id long, text string, lang string, slot string, size int")
    where = check(shards.kd_shards(docs, leaves=8).collect(), texts, 8, 0.05)
    assert all(len(s) == 1 for s in where.values())
    check(shards.kd_shards(docs, leaves=3).collect(), texts, 3, 0.05)
    made = shards.kd_shards(docs, target_bytes=20_000).collect()
    total = sum(r["size"] for r in made)
    check(made, texts, -(-total // 20_000), 0.15)
    assert shards.kd_shards(docs.limit(0), leaves=8).count() == 0
    assert [r.slot for r in shards.kd_shards(docs.limit(1), leaves=8).collect()] == [0]


def test_group_above_a_shard_is_dealt_by_documents(spark):
    texts = [(i, "hot " * 10) for i in range(1500)] + [(2000 + i, f"text {i} " * 3) for i in range(2000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    check(shards.kd_shards(docs, leaves=8).collect(), texts, 8, 0.05)


def test_op9_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    made = queries.op9_kd_shards(spark, sf).collect()
    where = check(made, texts, 8, 0.05)
    assert all(len(s) == 1 for s in where.values()) and {r.law for r in made} == {"bytes"} and {r.grown_shard for r in made} == {None}
