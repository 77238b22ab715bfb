"""The similarity join against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pairlight.llm import jaccard
from test_simhash import smallest

SCHEMA = "doc_id bigint, text string, node string, n int, digest int, hub int, root int, col int"


def grams(text, k=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k=3, percent=90):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(frozenset(grams(t, k)), i)
            sets[frozenset(grams(t, k))] = min(i, sets[frozenset(grams(t, k))])
    have = [(s, i) for s, i in sets.items() if s]
    links = [(i, j) for a, (s, i) in enumerate(have) for t, j in have[:a] if 100 * len(s & t) >= percent * len(s | t)]
    root = smallest([i for _, i in have], links)
    return [(i, len(g), i if not g else root.get(sets.get(frozenset(g)))) for i, t in rows for g in [grams(t, k)]]


def family(rnd, size, words, edits, first):
    """Copies of one text, each with some words of its own."""
    base = [rnd.choice("abcdefgh") * rnd.randint(1, 4) for _ in range(words)]
    for k in range(size):
        own = list(base)
        for _ in range(edits):
            own[rnd.randrange(words)] = f"own{first + k}x{rnd.random()}"
        yield first + k, " ".join(own)


def some_rows():
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 14)))) for i in range(150)]
    for k, (words, edits) in enumerate([(200, 1), (200, 3), (120, 2), (60, 1), (100, 0), (31, 1), (400, 6)]):
        rows += family(rnd, 25, words, edits, 1000 * (k + 1))
    common = " ".join(f"shared{i}" for i in range(60))
    rows += [(9000 + i, common + " " + " ".join(f"t{rnd.randrange(10**6)}" for _ in range(rnd.choice([2, 3, 4, 60])))) for i in range(40)]
    rows += [(9500 + i, common + " tail" * i) for i in range(12)]  # a chain of growing texts
    rows += [(None, "a b c d"), (None, None), (7777, None), (7778, ""), (7779, " \t\n"), (7780, "One"), (7781, "one"), rows[0], (rows[3][0], "other words here now"), (7790, "long " * 30_000)]
    return rows


@pytest.mark.parametrize("tile, bits", [(512, 18), (4, 6)])
def test_against_all_pairs(spark, tile, bits):
    rows = some_rows()
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in rows], SCHEMA).repartition(3)
    got = [tuple(r)[:3] for r in jaccard.similar(docs, tile=tile, bits=bits).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert len({g[2] for g in got}) < len(rows) - 90


def test_other_thresholds(spark):
    rows = [r for r in some_rows() if r[0] != 7790]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r)[:3] for r in jaccard.similar(docs, words=2, percent=70).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 2, 70), key=str)


def test_no_rows(spark):
    assert jaccard.similar(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_bounds():
    for percent in (50, 70, 90, 100):
        for a in range(1, 60):
            for b in range(a, 60):
                least = min((i for i in range(a + 1) if 100 * i >= percent * (a + b - i)), default=None)
                if least is not None:
                    assert jaccard.least_overlap(a, b, percent) == least
                    assert jaccard.first_places(a, percent) >= a - least + 1 and jaccard.first_places(b, percent) >= b - least + 1


def test_shingle_sets():
    rnd = random.Random(1)
    for _ in range(200):
        t = " ".join(rnd.choice(["a", "B", "c", "É", "d\x1ce"]) for _ in range(rnd.randint(0, 30)))
        made = jaccard.shingle_set(t, 3, jaccard._Hashes())
        assert len(made) == len(grams(t)) and np.all(np.diff(made.astype(object)) > 0)


def test_rows_without_id_link(spark):
    base = [f"w{i}" for i in range(64)]
    text = lambda n: " ".join(base[:n])
    rows = [(2, text(50)), (None, text(54)), (None, text(54)), (1, text(58)), (5, text(64)), (None, "quite another text"), (None, "quite another text indeed")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(2, 48, 1), (None, 52, 1), (1, 56, 1), (5, 62, 1), (None, 2, None), (None, 1, None)}


def test_odd_blocks_never_drop_a_link_and_tell_long_sets_apart():
    rnd = np.random.default_rng(5)
    draw = lambda n: np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
    for n in (0, 1, 3, 20, 100, 700, 3000, 5000, 20_000):
        a = draw(n)
        sets = [np.concatenate([a[k:], draw(m)]) for k, m in ((0, 0), (n // 30, n // 30), (0, n // 9), (n // 10, 0), (n // 2, n // 2), (n, n))]
        for blocks in (jaccard.few_blocks, jaccard.fine_blocks):
            odd = jaccard._Odd([jaccard.odd_blocks(x, blocks(len(x))) for x in sets])
            i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
            least = odd.least_apart(i, odd, j)
            for x, y, d in zip(i, j, least):
                assert d <= len(np.setxor1d(sets[x], sets[y]))
            if n >= 100:  # sets of other members, and of half their members, leave no room for a link, however long
                assert min(least[i == 0][4:]) > jaccard.most_apart(n, n)


def test_a_family_is_joined_before_its_pairs_are_made(spark, monkeypatch):
    """Copies with two to four of 400 words replaced: pairs link with up to six replaced in both, so the smallest, with four, reaches few."""
    rnd = random.Random(31)
    base = [f"w{rnd.randint(0, 10**9)}" for _ in range(400)]
    docs = []
    for d in range(160):
        words = base[: 400 - (d % 3 == 2)]
        for i in rnd.sample(range(0, 400, 5), 2 + d % 3):
            words[i] = f"x{rnd.randint(0, 10**9)}"
        docs.append((d, " ".join(words)))
    asked, multiplied = [], jaccard._multiplied
    monkeypatch.setattr(jaccard, "_multiplied", lambda pairs, *rest: asked.append(pairs.count()) or multiplied(pairs, *rest))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in jaccard.similar(df).collect()) == sorted(brute(docs))
    assert len(asked) == 2 and sum(asked) < 12 * len(docs), asked


def test_rows_that_met_in_the_column_before_are_no_pair_again():
    """Sets 1 and 2 share three columns in a row, sets 1 and 3 only the last of them."""
    odd = bytes(32)
    rows = [(g, node, 40, pos, node, before, odd) for g, node, pos, before in
            [(5, 1, 1, 0), (5, 2, 1, 0), (6, 1, 2, 5), (6, 2, 2, 5), (7, 1, 3, 6), (7, 2, 3, 6), (7, 3, 1, 0)]]
    batch = pa.RecordBatch.from_pylist([dict(zip(("g", "node", "n", "pos", "root", "before", "odd"), r, strict=True)) for r in rows])
    made = [(r["hub"], r["node"]) for b in jaccard._apart(iter([batch]), 90) for r in b.to_pylist()]
    assert sorted(made) == [(1, 2), (1, 3), (2, 3)]
