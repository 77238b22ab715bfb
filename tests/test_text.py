import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlight.functions import text as tx
from pairlight.functions import vectors
from pairlight.operators import chunking, mentions, pairs


def windows(spark, text, **kw):
    df = spark.createDataFrame([(text,)], "text string")
    return df.select(tx.chunk_windows(F.col("text"), **kw).alias("w")).first().w


def test_consecutive_windows_share_the_overlap(spark):
    got = windows(spark, " ".join(f"w{i}" for i in range(500)), size=100, overlap=20)
    assert got[0].split()[-20:] == got[1].split()[:20]


def test_every_word_is_covered(spark):
    words = [f"w{i}" for i in range(437)]
    got = windows(spark, " ".join(words), size=100, overlap=25)
    assert {w for g in got for w in g.split()} == set(words)


def test_one_window_keeps_short_text_whole(spark):
    assert windows(spark, "  a\n b c ") == ["a b c"]


def test_blank_text_has_no_window(spark):
    for text in ("", " \n\t ", None, " "):
        assert windows(spark, text) == []


def test_short_windows_are_dropped_and_not_numbered(spark):
    df = spark.createDataFrame([("a b c d loooooooooooong words here e f",)], "text string")
    rows = chunking.chunk_texts(df, size=2, overlap=0).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.chunk_text) for r in rows] == [(0, "loooooooooooong words")]


def test_overlap_must_be_smaller_than_size():
    with pytest.raises(ValueError):
        tx.chunk_windows(None, size=10, overlap=10)


def test_windows_match_a_plain_loop(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bb", "cccccc", "dddddddddd"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.w for r in df.select("id", tx.chunk_windows(F.col("text"), 7, 3).alias("w")).collect()}
    for i, text in enumerate(texts):
        words = text.split(" ")
        if len(words) <= 7:
            want = [text]
        else:
            ends = range(7, len(words) + 4, 4)
            want = [" ".join(words[e - 7:e]) for e in ends]
            want = [w for w in want if len(w) >= 15]
        assert got[i] == want, text


def test_hash_vector_equals_digest_bytes(spark):
    import hashlib

    got = spark.createDataFrame([("héllo",)], "t string").select(vectors.hash_vector(F.col("t"), 40).alias("v")).first().v
    digest = hashlib.sha256("héllo".encode()).digest()
    assert got == pytest.approx([(digest[i % 32] - 127.5) / 127.5 for i in range(40)])


def test_model_embedder_batches_and_skips_missing_text(spark):
    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("a",), (None,), ("abc",)], "t string")
    rows = vectors.ModelEmbedder(load, 2, batch=1)(df, "t", "v").collect()
    assert [r.v for r in rows] == [[1.0, 1.0], None, [3.0, 1.0]]


def test_pool_and_norm(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 1), ("a", [3.0, 4.0], 1), ("a", [9.0, 9.0], 0), ("b", [1.0, 1.0], 0)],
                               "k string, v array<double>, m int")
    got = {r.k: r.pooled for r in vectors.mean_pool(df, "k", "v", "m").collect()}
    assert got == {"a": [2.0, 3.0], "b": [0.0, 0.0]}
    unit = df.select(vectors.normalise(F.array(F.lit(3.0), F.lit(4.0))).alias("u")).first().u
    assert unit == pytest.approx([0.6, 0.8])


MENTIONS = [
    ("Take with Ibuprofen.", "ibuprofen", True),
    ("ibuprofenlike", "ibuprofen", False),
    ("NSAIDs raise risk", "nsaid", False),
    ("NSAIDs raise risk", "nsaids", True),
    ("a beta-blocker here", "beta blocker", False),
    ("a Beta Blocker here", "beta blocker", True),
    ("see (foo) now", "(foo)", False),
    ("see x(foo)y now", "(foo)", True),
    ("cost is 3.5 mg", "3.5", True),
    ("cost is 315 mg", "3.5", False),
    ("caféine", "caf", False),
    ("a--b", "--", True),
    ("a -- b", "--", False),
    ("naïve use", "NAÏVE", True),
    ("blank", "  ", False),
]


def test_whole_word_matching(spark):
    texts = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(MENTIONS)], "chunk_id int, text string")
    terms = spark.createDataFrame([(t,) for t in {t for _, t, _ in MENTIONS}], "term string")
    got = {(r.chunk_id, r.term) for r in mentions.match_terms(texts, terms).collect()}
    for i, (text, term, want) in enumerate(MENTIONS):
        assert ((i, term) in got) == want, (text, term)


def test_matching_against_brute_force(spark):
    import re

    rng = random.Random(3)
    parts = ["aa", "bb", "a-b", "(c)", "dd", "é", "x.y", "AA"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 8))) for _ in range(80)]
    terms = sorted({" ".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(60)})
    t = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string")
    d = spark.createDataFrame([(x,) for x in terms], "term string")
    got = {(r.chunk_id, r.term) for r in mentions.match_terms(t, d).collect()}
    want = {(i, x) for i, s in enumerate(texts) for x in terms if re.search(r"\b" + re.escape(x) + r"\b", s, re.IGNORECASE)}
    assert got == want


def test_long_terms_and_very_many_positions(spark):
    words = ["the"] * 5000 + ["rare", "find"] + ["the"] * 5000
    t = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, ""), (4, "--"), (5, "the-the")], "chunk_id int, text string")
    terms = ["the the", "rare find", "the rare find the", "find rare", "the " * 30 + "the", "The-the", "the  the", None, "  ", "the the"]
    d = spark.createDataFrame([(x,) for x in terms], "term string")
    got = sorted((r.chunk_id, r.term) for r in mentions.match_terms(t, d).collect())
    assert got == sorted([(1, "the the"), (1, "rare find"), (1, "the rare find the"), (1, "the " * 30 + "the"), (5, "The-the")])
    assert mentions.match_terms(t, d.where("term = '  '")).collect() == []
    assert mentions.match_terms(t.where("chunk_id < 0"), d).collect() == []


def test_token_path_of_a_model(spark):
    """Cut, padding by width, mask and scale against a plain loop; rows come back in their order."""
    rng = random.Random(6)

    def load():
        return (lambda texts: [[len(w) for w in t.split()] for t in texts]), (lambda ids, mask: np.stack([ids + 1.0, ids * ids], axis=2) * 1.0 + (~mask[:, :, None]) * 1e6)

    texts = [" ".join("x" * rng.randint(1, 9) for _ in range(rng.choice([0, 1, 3, 15, 16, 17, 40, 300]))) for _ in range(120)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    made = {r.id: r.v for r in vectors.TokenEmbedder(load, 2, batch=4, max_tokens=20)(df, "t", "v").collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert made[i] is None
            continue
        tokens = [len(w) for w in t.split()][:20]
        mean = np.array([[x + 1.0, x * x] for x in tokens]).mean(axis=0) if tokens else np.zeros(2)
        assert np.allclose(made[i], mean / max(np.linalg.norm(mean), 1e-12)), t
    with pytest.raises(Exception, match="the model returned"):
        vectors.TokenEmbedder(load, 3)(df, "t", "v").collect()


def test_mentions_keep_term_order_and_first_class_wins(spark):
    texts = spark.createDataFrame([("c1", "Advil and ibuprofen are NSAIDs, an nsaid")], "chunk_id string, text string")
    terms = spark.createDataFrame([("5640", "ibuprofen", 0), ("5640", "Advil", 1), ("1", "warfarin", 0)],
                                  "rxcui string, term string, ord int")
    row = mentions.owner_mentions(texts, terms).first()
    assert (row.rxcui, row.matched_terms) == ("5640", ["ibuprofen", "Advil"])
    classes = spark.createDataFrame([("nsaid", 0, "ibuprofen"), ("nsaids", 1, "ibuprofen"), ("nsaids", 1, "aspirin")],
                                    "class_term string, ord int, member string")
    got = {r.member: r.class_term for r in mentions.class_mentions(texts, classes).collect()}
    assert got == {"ibuprofen": "nsaid", "aspirin": "nsaids"}


def names_to_pairs(spark, names):
    df = spark.createDataFrame([(names,)], "n array<string>")
    return [tuple(p) for p in df.select(pairs.unordered_pairs(pairs.first_spellings(F.col("n"))).alias("p")).first().p]


def test_pairs(spark):
    assert len(names_to_pairs(spark, list("ABCD"))) == 6
    assert len(names_to_pairs(spark, [f"d{i}" for i in range(10)])) == 45
    assert names_to_pairs(spark, ["Warfarin", " warfarin ", "", "Ibuprofen"]) == [("Warfarin", "Ibuprofen")]
    assert names_to_pairs(spark, ["one"]) == [] and names_to_pairs(spark, []) == []


def test_names(spark):
    good = ["Acetaminophen 500 mg", "St. John's wort", "co-trimoxazole (80/400)", "5% dextrose", "x" * 200, "a b"]
    bad = ["", "   ", "x" * 201, "a<b", "a>b", "a;b", "{a}", "a`b", "a\x00b", "naïve"]
    df = spark.createDataFrame([(n,) for n in good + bad], "name string")
    reasons = {r.name: r.reason for r in pairs.check_names(df).collect()}
    assert all(reasons[n] is None for n in good)
    assert all(reasons[n] is not None for n in bad)


def test_regimens(spark):
    lists = {1: ["a"], 2: [f"n{i}" for i in range(11)], 3: ["a", "A ", "b"], 4: ["a", "<"], 5: ["a", "b", "c"], 6: ["b", "a", "B", "A", "b"]}
    df = spark.createDataFrame([(k, i, n) for k, v in lists.items() for i, n in enumerate(v)], "regimen_id int, pos int, name string")
    got = {r.regimen_id: r for r in pairs.check_regimens(df).collect()}
    assert got[1].reason == "At least two drug names are required."
    assert got[2].reason == "Too many drugs: 11 given, maximum is 10."
    assert got[3].reason == "Duplicate drug name(s) in request: A."
    assert "not allowed" in got[4].reason
    assert got[5].reason is None and got[5].names == ["a", "b", "c"]
    assert got[6].reason == "Duplicate drug name(s) in request: A, B, b."
    assert pairs.regimen_pairs(pairs.check_regimens(df)).count() == 3


def test_regimens_are_shuffled_once(spark, capsys):
    rows = [(1, 2, "Ab"), (1, 1, " cd "), (1, 3, "ef"), (2, 1, "x1"), (2, 2, "X1 "), (3, 1, "one"), (4, 1, "ok"), (4, 2, "<b>"), (None, 1, "p"), (None, 2, "q")]
    rows += [(5, i, f"n{i}") for i in range(2000)]
    names = spark.createDataFrame(rows, "regimen_id bigint, pos int, name string")
    checked = pairs.check_regimens(names)
    got = {r.regimen_id: (r.n_names, r.names, r.reason is None) for r in checked.collect()}
    assert got == {1: (3, ["cd", "Ab", "ef"], True), 2: (2, None, False), 3: (1, None, False), 4: (2, None, False), 5: (2000, None, False), None: (2, ["p", "q"], True)}
    out = pairs.regimen_pairs(checked)
    assert {tuple(r) for r in out.collect()} == {(1, 1, "cd", "Ab"), (1, 2, "cd", "ef"), (1, 3, "Ab", "ef"), (None, 1, "p", "q")}
    capsys.readouterr()
    pairs.regimen_pairs(pairs.check_regimens(names)).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1
