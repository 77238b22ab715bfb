"""The filter audit against masks made text by text and orders walked one by one."""

import random
from collections import Counter
from itertools import permutations

from pairlight.llm import filters
from pairlight.llm.queries import op11_filter_audit

SCHEMA = "doc_id bigint, text string, source string, bucket int, mask int, digest string, n int, quality int"


def masks(rows):
    """(doc_id, part, mask) per row."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, source in rows:
        t = text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", t) if w]
        yield i, source or "", ((len(words) < 50) + 2 * (100 * len(set(words)) < 65 * len(words)) + 4 * (100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t))
                                + 8 * any(c in "#$%&*|" for c in t) + 16 * (i is not None and i > least[t]))


def walked(marked, labels):
    out = {}
    for part in {p for _, p, _ in marked}:
        rows = [(m, labels.get(i, (None, None))) for i, p, m in marked if p == part]
        for order in permutations("ABCDE"):
            alive = rows
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone = [r for r in alive if r[0] & bit]
                alive = [r for r in alive if not r[0] & bit]
                fails = [r for r in rows if r[0] & bit]
                out[part, "".join(order), step] = [len(alive), len(gone), len(fails) - len(gone), sum(r[0] == bit for r in rows), sum(r[1][0] == 1 for r in gone), sum(r[1][1] == 1 for r in gone)]
    removed = Counter()
    for (part, order, step), v in out.items():
        removed[part, order[step - 1]] += v[1]
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


def test_text_mask():
    for t in ["", " \n", "a " * 50, "é É " * 30, "A b|", "x\x1cy " * 50, "AB " + "c" * 40, " ".join(map(str, range(60)))]:
        assert filters.text_mask(t.encode()) == next(masks([(1, t, "s")]))[2], t


def test_orders_of_arrival(spark, tmp_path):
    """Copies in every order over many files: retractions, repeated ids and rows, null ids, texts, parts and labels."""
    rnd = random.Random(5)
    texts = ["", None, "# one", "w " * 60, " ".join(map(str, range(70))), "UP PER " * 5, "é" * 20_000 + " $"]
    rows = [(rnd.randrange(40), rnd.choice(texts), rnd.choice(["s1", "s2", "", None])) for _ in range(120)]
    rows += [(None, "# one", "s1"), (None, None, None), rows[0], rows[0]]
    folder = f"{tmp_path}/documents.parquet"
    for k in range(0, len(rows), 20):
        spark.createDataFrame([(*r, 1, 2, "d", 3, 1) for r in rows[k : k + 20]], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    labels = spark.createDataFrame([(i, i % 2, (i % 3 == 0) * 1) for i in range(0, 40, 2)] + [(2, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    known = {i: (i % 2, (i % 3 == 0) * 1) for i in range(0, 40, 2)} | {2: (1, 0)}
    made = filters.count_masks(spark, folder, labels, files=1)
    want = Counter((p, m, known.get(i, (0, 0))[0] == 1, known.get(i, (0, 0))[1] == 1) for i, p, m in masks(rows))
    assert {tuple(r)[:4]: r["n"] for r in made.collect()} == want
    assert found(filters.interactions(made)) == walked(list(masks(rows)), known)


def test_retraction():
    kept = {}
    assert filters.settle([(b"t", 9, 1, "p", True, False, 1)], kept) == {("p", 1, True, False): 1}
    assert filters.settle([(b"t", 9, 1, "q", False, False, 1), (b"t", 12, 1, "p", False, False, 3)], kept) == {("q", 1, False, False): 1, ("p", 17, False, False): 3}
    assert filters.settle([(b"t", 4, 1, "r", False, False, 1)], kept) == {
        ("p", 1, True, False): -1, ("p", 17, True, False): 1, ("q", 1, False, False): -1, ("q", 17, False, False): 1, ("r", 1, False, False): 1}
    assert kept[b"t"][0] == 4


def test_empty_table_and_query(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert op11_filter_audit(spark, str(tmp_path)).collect() == []
