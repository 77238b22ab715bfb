"""Restored words, held-out accuracy, and odd tables."""

import zlib

import numpy as np

from pairlight.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def letters(spark):
    return toxicity.log_model(toxicity.trigram_counts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")))


def test_counts_cover_all_texts(spark):
    docs = spark.createDataFrame([("Ab c",), (None,), ("",), ("a  b" * 9000,), ("日1",)], "text string")
    assert toxicity.trigram_counts(docs).sum() == sum(len(toxicity.classes(t)) + 1 for t in ("Ab c", "a  b" * 9000, "日1"))
    assert toxicity.trigram_counts(docs.limit(0)).sum() == 0


def test_restores_disguised_words(spark):
    model = letters(spark)
    for written, meant in {"1d1ot": "idiot", "m0r0n": "moron", "tr@sh": "trash", "p@th3t1c": "pathetic", "w0rthl3ss": "worthless", "scuuum": "scum", "l.o.s.e.r": "loser", "5tup1d!": "stupid"}.items():
        assert any(meant in toxicity.readings(t, model) for t in toxicity.tokens(written)), written
    assert "loser" in toxicity.tokens("you l o s e r there")
    assert toxicity.readings("plain", model) == ["plain"] and toxicity.readings("...", model) == []


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "bad worm here", "a"), (1, "bad worm here", "a"), (2, None, "b"), (3, "", "c"), (4, "fine words " * 3000, "d"), (None, "bad worm", "e")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 0), (4, None), (99, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, min_docs=1)
    made = toxicity.score(docs, model).collect()
    assert len(made) == 6 and all(0 <= r.toxicity <= 1 for r in made)
    by = {r.doc_id: r.toxicity for r in made}
    assert by[1] > by[4] and by[None] == by[1] and by[2] == by[3]
    empty = toxicity.train(docs.limit(0), labels.limit(0))
    assert toxicity.score(docs.limit(0), empty).count() == 0 and len({r.toxicity for r in toxicity.score(docs, empty).collect()}) == 1


def test_op5_held_out(spark):
    sf = "/root/testdata/sf0.1"
    made = {r.doc_id: r for r in queries.op5_toxicity(spark, sf).collect()}
    assert len(made) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for d, r in made.items())
    told = [(r.toxic, made[r.doc_id].predicted) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if made[r.doc_id].held_out]
    told = np.array(told)
    right = (told[:, 0] * told[:, 1]).sum()
    assert right / told[:, 0].sum() > 0.85 and right / told[:, 1].sum() > 0.9
