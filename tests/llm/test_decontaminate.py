"""Exact windows against brute force, and proximity."""

import hashlib
import re

from pyspark.sql import functions as F

from pairlight.llm import decontaminate as dc
from pairlight.llm import queries


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, items, n=10):
    windows = {}
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - n + 1)):
            if w:
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if s := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= s
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def test_hits(spark):
    long = "alpha beta gamma delta eps zeta eta theta iota kappa lambda mu"
    items = [(1, long), (2, "Short item"), (3, None), (4, "..."), (5, long.upper()), (11, "the the the"), (12, "ünï çode")]
    docs = [(1, "x " + long + " y " + long), (2, long.replace("theta", "THETA!")), (3, "a short-item, short  item"), (4, None), (5, ""), (6, "the " * 50), (7, "alpha beta gamma"),
            (8, "ünï, çode"), (9, " ".join(long.split()[:10])), (9, " ".join(long.split()[:10])), (9, "other text"), (None, "short item"), (10, "zz " * 3000 + long)]
    d = spark.createDataFrame([(*r, "e") for r in docs], "doc_id long, text string, version string")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id int, text string, window int")
    for anchors in (1, 2, 3):
        got = sorted([(r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in dc.contamination(d, i, anchors=anchors).collect()], key=str)
        assert got == slow(docs, items)
    dirty = {r[0] for r in slow(docs, items) if r[2]}
    assert sorted(map(str, [r.doc_id for r in dc.clean(d, i).collect()])) == sorted(map(str, [x for x, t in docs if not slow([(x, t)], items)[0][2]])) and dirty
    assert dc.clean(d, i).columns == d.columns
    assert dc.contamination(d.limit(0), i).count() == 0
    assert {r.n_hit for r in dc.contamination(d, i.limit(0)).collect()} == {0}


def test_near(spark):
    d = spark.createDataFrame([(1, "rare1 x common rare2"), (2, "rare2 y y rare1 common"), (3, "rare1 " + "y " * 20 + "rare2"), (4, "common common")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "rare1 common rare2")], "item_id long, text string")
    index = dc.PositionalIndex(d, i, window=3, anchors=2)
    assert {r.doc_id for r in index.near(3).collect()} == {1, 2}
    assert {r.doc_id for r in index.near(0).collect()} == set()
    assert {r.doc_id for r in index.near(40).collect()} == {1, 2, 3}


def test_op4_query(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()]
    got = {r.doc_id: r for r in queries.op4_decontamination(spark, sf).collect()}
    for d, n, hit, found in slow(read("documents", "doc_id"), read("benchmark", "item_id")):
        r = got.pop(d)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
    assert not got
    assert spark.range(1).select(F.size(dc.words_of(F.lit(None).cast("string"))).alias("n")).first().n == 0
