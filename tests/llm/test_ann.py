"""Recall and exact scores against brute force."""

import numpy as np

from pairlight.llm import ann, queries


def slow(ids, x, q, k):
    s = (x * x[q]).sum(1)
    return [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s)) if i != q][:k]


def test_ties_bad_vectors_and_dimensions(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(i, one) for i in range(40)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [float("nan"), 1.0, 1.0]), (103, [None, 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0]), (105, []), (None, one), (106, [1.0]), (107, [2.0]), (108, [1e30, -1e30, 1.0])]
    df = spark.createDataFrame([(*r, "e") for r in rows], "vec_id long, embedding array<double>, code string")
    coded = ann.index(df)
    assert sorted(r.vec_id for r in coded.collect()) == [*range(40), 106, 107, 108]
    found = {}
    for r in ann.search(coded, coded.where("vec_id in (0, 30, 106, 108)"), k=20, slice_rows=8, block=2).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert [v for _, v, _ in sorted(found[0])] == [*range(1, 21)] and [v for _, v, _ in sorted(found[30])] == [*range(20)]
    assert sorted(found[106]) == [(1, 107, 2.0)] and len(found[108]) == 20
    assert ann.search(coded, coded.limit(0)).count() == 0 and ann.index(df.limit(0)).count() == 0


def test_recall_on_random_vectors(spark):
    rng = np.random.default_rng(3)
    for dim in (5, 64, 100):
        x = rng.standard_normal((1500, dim)).astype(np.float32)
        ids = rng.permutation(1500)
        coded = ann.index(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>"))
        hit = n = 0
        found = {}
        for r in ann.search(coded, coded.where("vec_id % 50 = 0"), k=20, slice_rows=400).collect():
            found.setdefault(r.query_id, {})[r.vec_id] = r.score
        for q in np.flatnonzero(ids % 50 == 0):
            want = slow(ids, x.astype(float), q, 20)
            hit += len({i for i, _ in want} & set(found[int(ids[q])]))
            n += 20
        assert hit / n >= 0.97


def test_op10_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    found = {}
    for r in queries.op10_one_bit_ann(spark, sf).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in np.flatnonzero(ids % 20 == 0):
        want, got = slow(ids, x, q, 20), sorted(found[int(ids[q])])
        assert [g[0] for g in got] == [*range(1, 21)]
        hit += len({i for i, _ in want} & {g[1] for g in got})
        assert all(abs(g[2] - x[q] @ x[np.flatnonzero(ids == g[1])[0]]) < 1e-12 for g in got)
    assert hit / (20 * len(found)) >= 0.9 and len(found) == (ids % 20 == 0).sum()
