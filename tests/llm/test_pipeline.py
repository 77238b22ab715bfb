"""Each stage of the corpus pipeline against a brute-force version on its own input."""

import base64

import public_tokenizers as P
import tiktoken
from test_decontaminate import slow as slow_hits
from test_lines import slow as slow_lines
from test_simhash import slow as slow_print
from test_simhash import smallest

import corpus_pipeline
from pairlight.llm import queries, toxicity
from pairlight.session import cut

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "byte_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kinds, tables = docs.dtypes, [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(cut(stage(spark, tables[-1], SF)))
    assert all(t.dtypes == kinds for t in tables[:-1])
    rows = [{r.doc_id: r for r in t.collect()} for t in tables]

    model = toxicity.train(docs, queries.learnable(spark.read.parquet(f"{SF}/labels.parquet")))
    top = model.scorer()
    z = {d: sum(a * b for a, b in zip((*top(r.text), 1.0), model.fit)) for d, r in rows[0].items()}
    assert set(rows[1]) == {d for d, x in z.items() if x < 0} and all(rows[1][d] == rows[0][d] for d in rows[1])

    cleaned = slow_lines([(d, r.text) for d, r in rows[1].items()])
    want = {d: kept for d, (kept, _, _, gone) in cleaned.items() if not gone or len(kept.split()) >= corpus_pipeline.LEAST_KEPT * len(rows[1][d].text.split())}
    assert {d: (r.text, r.n_chars) for d, r in rows[2].items()} == {d: (t, len(t)) for d, t in want.items()}

    prints = {d: slow_print(r.text) for d, r in rows[2].items()}
    ids = sorted(prints)
    root = smallest(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    assert set(rows[3]) == set(root.values())

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = slow_hits([(d, r.text) for d, r in rows[3].items()], items)
    assert set(rows[4]) == {d for d, _, n, _ in hit if not n}

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {d: r.ids for d, r in rows[5].items()} == {d: lib.encode_ordinary(r.text) for d, r in rows[4].items()}
    assert all(r.exact and r.n_tokens == len(r.ids) for r in rows[5].values())


def test_odd_rows(spark):
    """Nulls, repeated rows, ties and an empty table go through every stage."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 4000, "en", "s", 20000), (3, "word " * 4000, "en", "s", 20000), (4, "x\n\n\ny. z. ", "fr", None, 10), (None, "no id here", "en", "s", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        now = table
        for _, stage in corpus_pipeline.STAGES:
            now = cut(stage(spark, now, SF))
        assert sorted(map(str, [r.doc_id for r in now.collect()])) == ([] if table is not docs else ["1", "3", "3", "4", "None"])


def test_run(spark):
    made = corpus_pipeline.run(spark, SF)
    assert made.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "exact"] and made.count() > 0


def test_line_dedup_keeps_documents_with_words_left(spark):
    """A document that repeats its own paragraph stays with one copy of it; one that consists of others' chunks goes."""
    own = " ".join(f"own{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(1, other), (2, "\n".join([own] * 20)), (3, "\n".join([other] * 20) + "\nthree words left"), (4, other), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "cast(length(text) as bigint) n_chars")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()}
    assert {d: t and t.strip() for d, t in got.items()} == {1: other, 2: own, 3: "three words left", 5: None, 6: ""}
