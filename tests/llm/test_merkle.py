"""Merkle manifests against trees built node by node."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pairlight.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf int, proof string, tree string, idx int"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, more=0):
    n = None if r[3] is None else r[3] + more
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], n, r[4])))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    for row in tree[:-1]:
        yield None if i ^ 1 >= len(row) else ("L" if i % 2 else "R", row[i ^ 1])
        i >>= 1


def brute(rows, tampered):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for g in names:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: levels([leaf(r) for r in by[g]]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(by[g]):
            path = [*siblings(trees[g], i), *siblings(top, k)]
            end = leaf(r, int(tampered(r[0])))
            for s in path:
                end = h(end) if s is None else h(s[1] + end) if s[0] == "L" else h(end + s[1])
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], "".join("S" if s is None else s[0] + s[1] for s in path), end, end == top[-1][0]))
    return sorted(out, key=str)


def compare(spark, rows, per_stage):
    docs = spark.createDataFrame([(*r, 1, "p", "t", 2) for r in rows], SCHEMA).repartition(3)
    claimed = {"n_chars": F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    got = sorted((tuple(r) for r in merkle.manifest(docs, claimed=claimed, levels=per_stage).collect()), key=str)
    assert got == brute(rows, lambda i: i is not None and i % 3 == 0)
    return got


@pytest.mark.parametrize("per_stage", [1, 2, 12])
def test_against_brute_force(spark, per_stage):
    rows = [(i, f"s{i % 4}", ("de", "en", "é", None, "")[min(i % 7, 4)], None if i % 5 == 0 else i, "x" * (i % 3)) for i in range(60)]
    rows += [(None, None, None, None, None), (7, "a", "en", 1, "same"), (7, "a", "en", 1, "same"), (7, "a", "en", 2, "other"), (90, "b", "one", 5, "é" * 50_000)]
    got = compare(spark, rows, per_stage)
    assert {r[0] for r in got if not r[-1]} == {i for i in range(60) if i % 3 == 0 and i % 5} | {90}


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9])
def test_small_trees(spark, n):
    compare(spark, [(i, "s", "en", i, "t") for i in range(n)], 1)


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_altered_proofs_are_found():
    digests = [h(str(i)) for i in range(5)]
    made = merkle.climb(0, digests, 3)
    for at, proof in merkle.descend(made, 3, 0, "").items():
        assert merkle.fold(digests[at], proof) == made[3, 0]
        assert merkle.fold(digests[at][::-1], proof) != made[3, 0]
        flip = proof.replace("L", "l").replace("R", "L").replace("l", "R")
        assert flip == proof or merkle.fold(digests[at], flip) != made[3, 0]
