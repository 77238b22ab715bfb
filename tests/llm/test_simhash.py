"""Fingerprints, bit-sliced comparison and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from pairlight.llm import graph, queries, simhash


def slow(text, k=4):
    words = text.encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints():
    rnd = random.Random(2)
    texts = ["", " \n", "a", "A b C", "a b c d", "a\x0bb\x1cc d e É ß", "w " * 300] + [" ".join(rnd.choice("abcd") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 600))) for _ in range(40)]
    assert [simhash.fingerprint(t) for t in texts] == [slow(t) for t in texts]


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7, 10])
def test_close_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    fps = rng.permutation(np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)), base[:80] ^ np.uint64(0b11111), base[:80] ^ np.uint64(0b1111)]))
    ends = np.where(np.arange(len(fps)) < 201, 201, len(fps))
    got = {p for i, j in simhash.close_pairs(fps, ends, radius) for p in zip(i.tolist(), j.tolist())}
    assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, ends[i]) if int(fps[i] ^ fps[j]).bit_count() <= radius}


def test_links_of_split_groups(spark):
    """A group far above the chunk size is split into tiles and loses no link."""
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (300, 3))} | {int(x) for x in rng.integers(0, 2**62, 200)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    classes = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, rep long")
    found = {r.node: r.root for r in graph.components(simhash.links(classes, chunk=16)).collect()}
    want = smallest(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert {i: found.get(i, i) for i in want} == want


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 700)]
    rows = [*chain, *star, (1, 1), (2, 3), (2, 3), (3, 2), (None, 4)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    want = smallest({x for r in rows for x in r if x is not None}, [r for r in rows if None not in r])
    assert found == {k: v for k, v in want.items() if k not in (1, 4)}


def test_near_duplicates(spark):
    rows = [(3, "one two three four five", "x"), (1, "One TWO three four five", "x"), (2, None, "x"), (7, "", "x"), (9, "alone here", "x"), (9, "alone here", "x"), (None, "nothing", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    made = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.component_id) for r in made), key=str) == sorted([(3, 1), (1, 1), (2, 2), (7, 2), (9, 9), (9, 9), (None, None)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "2", "9", "9", "None"]


def test_op2_query(spark):
    sf = "/root/testdata/sf0.001"
    prints = {r.doc_id: slow(r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(prints)
    want = smallest(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, sf).collect()} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}
