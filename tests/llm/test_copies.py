"""Near copies by shingles against brute force."""

import random

from test_simhash import slow as slow_print
from test_simhash import smallest

from pairlight.llm import copies

import corpus_pipeline


def runs(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def linked(a, b):
    x, y = runs(a), runs(b)
    return len(x & y) >= 0.8 * len(x | y) or (slow_print(a) ^ slow_print(b)).bit_count() <= 4


def corpus():
    rnd = random.Random(6)
    word = lambda: f"w{rnd.randint(0, 5000)}"
    docs = []
    for _ in range(12):
        text = [word() for _ in range(rnd.randint(40, 400))]
        for _ in range(6):
            new = list(text)
            for at in rnd.sample(range(len(new)), rnd.randint(0, max(1, len(new) // 40))):
                new[at] = word()
            docs.append(" ".join(new))
            if rnd.random() < 0.5:
                text = new  # a chain of copies
    docs += ["", " ", "one two", "One TWO", "one two three", docs[3].upper()]
    order = rnd.sample(range(1000), len(docs))
    return list(zip(order, docs))


def kept(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = copies.keep_first(docs, **how)
    assert made.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in made.collect()), key=str)


def test_first_copies(spark):
    rows = corpus()
    root = smallest([d for d, _ in rows], [(a, b) for a, x in rows for b, y in rows if a < b and linked(x, y)])
    want = sorted(((d, t) for d, t in rows if root[d] == d), key=str)
    far = sum(0.8 <= len(runs(x) & runs(y)) / max(1, len(runs(x) | runs(y))) and (slow_print(x) ^ slow_print(y)).bit_count() > 4 for a, x in rows for b, y in rows if a < b)
    assert far > 20
    assert kept(spark, rows) == want
    assert kept(spark, rows, chunk=2) == want  # groups in tiles lose no link
    stage = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in stage.collect()} == {d for d, _ in want}


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(5, text), (3, text + " more"), (5, "another text of the same id"), (None, text), (None, text), (7, None), (8, ""), (9, "alone"), (9, "alone")]
    assert kept(spark, rows) == sorted([(3, text + " more"), (5, text), (5, "another text of the same id"), (None, text), (None, text), (7, None), (9, "alone"), (9, "alone")], key=str)
    assert kept(spark, rows[:0]) == []
