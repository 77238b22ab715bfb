import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlight import vocab
from pairlight.functions.vectors import HashEmbedder
from pairlight.operators import pairs, resolve, search
from pairlight.plans import pair_evidence as pe

EMBED = HashEmbedder(16)
DRUGS = "drug_id bigint, rxcui string, normalized_name string, generic_name string, input_name string"


def knowledge(spark, chunks):
    drugs = spark.createDataFrame([
        (1, "11289", "warfarin", "warfarin", "Warfarin"), (2, "5640", "ibuprofen", "ibuprofen", "ibuprofen"),
        (3, "6809", "metformin", "metformin", "metformin"), (4, "1", "nothing", "nothing", "nothing"),
    ], DRUGS)
    synonyms = spark.createDataFrame([(1, "Coumadin", "brand", 1), (2, "Advil", "brand", 1)],
                                     "drug_id bigint, synonym string, synonym_type string, ord int")
    classes = spark.createDataFrame(
        [(t, i, m) for i, (t, ms) in enumerate(vocab.CLASS_TERMS.items()) for m in ms], "class_term string, ord int, member string")
    rows = [(f"c{i}", rxcui, text) for i, (rxcui, text) in enumerate(chunks)]
    index = EMBED(spark.createDataFrame(rows, "chunk_id string, rxcui string, text string"), "text", "embedding")
    return pe.Knowledge(drugs, synonyms, classes, index)


def run(spark, asked, chunks, k=5):
    known = knowledge(spark, chunks)
    table = spark.createDataFrame(asked, "drug_a string, drug_b string")
    resolved = pe.resolve_pairs(table, known)
    evidence = pe.evidence_for(pe.searchable(resolved), known, EMBED, k)
    status = {(r.drug_a, r.drug_b): r.evidence_status for r in pe.statuses_for(resolved, evidence).collect()}
    return status, evidence.orderBy("rxcui_a", "rxcui_b", "place").collect()


BASE = [("11289", "Avoid warfarin with ibuprofen, bleeding may follow."), ("11289", "Monitor the dose closely."),
        ("5640", "Take with food."), ("6809", "For blood sugar.")]


def test_statuses(spark):
    status, rows = run(spark, [
        ("warfarin", "ibuprofen"), ("warfarin", "metformin"), ("warfarin", "Coumadin"), ("warfarin", "notarealdrugxyz"),
        ("metformin", "nothing"), ("11289", "Advil"),
    ], BASE)
    assert status == {
        ("warfarin", "ibuprofen"): vocab.PAIR_FOUND, ("11289", "Advil"): vocab.PAIR_FOUND,
        ("warfarin", "metformin"): vocab.SUPPORT_FOUND, ("warfarin", "Coumadin"): vocab.INVALID,
        ("warfarin", "notarealdrugxyz"): vocab.NOT_FOUND, ("metformin", "nothing"): vocab.SUPPORT_FOUND,
    }
    first = [r for r in rows if (r.rxcui_a, r.rxcui_b) == ("11289", "5640")]
    assert first[0].classification == vocab.PAIR_SPECIFIC and first[0].evidence_id == "EVIDENCE-001"
    assert first[0].matched_terms_a == ["warfarin"] and first[0].matched_terms_b == ["ibuprofen"]
    assert len({r.chunk_id for r in first}) == len(first)
    assert all(r.rxcui in ("11289", "5640") for r in first)


def test_nothing_indexed_is_insufficient_never_safe(spark):
    status, rows = run(spark, [("metformin", "nothing")], BASE[:3])
    assert status == {("metformin", "nothing"): vocab.INSUFFICIENT} and rows == []


def test_class_level(spark):
    _, rows = run(spark, [("warfarin", "ibuprofen")], [("11289", "Do not use with NSAIDs."), ("5640", "Pain relief.")])
    got = {r.chunk_id: r for r in rows}
    assert got["c0"].classification == vocab.CLASS_LEVEL and got["c0"].class_match_b == "nsaids"
    assert got["c1"].classification == vocab.DRUG_SPECIFIC


def test_order_of_evidence_and_cap(spark):
    chunks = [("11289", f"text {i} on NSAIDs") for i in range(6)] + [("11289", f"plain text {i}") for i in range(6)]
    chunks += [("5640", f"warfarin note {i}") for i in range(3)]
    _, rows = run(spark, [("warfarin", "ibuprofen")], chunks, k=20)
    kinds = [r.classification for r in rows]
    assert kinds == [vocab.PAIR_SPECIFIC] * 3 + [vocab.DRUG_SPECIFIC] * 6 + [vocab.CLASS_LEVEL] * 6
    assert [r.evidence_id for r in rows] == [f"EVIDENCE-{i:03d}" for i in range(1, 9)] + [None] * 7
    for kind in set(kinds):
        distances = [r.distance for r in rows if r.classification == kind]
        assert distances == sorted(distances)


def test_general_label_evidence_needs_a_foreign_chunk(spark):
    items = spark.createDataFrame([("1", "2", "c", "9")], "rxcui_a string, rxcui_b string, chunk_id string, rxcui string")
    none = spark.createDataFrame([], "chunk_id string, rxcui string, matched_terms array<string>")
    no_class = spark.createDataFrame([], "chunk_id string, member string, class_term string")
    names = spark.createDataFrame([("1", "a"), ("2", "b")], "rxcui string, normalized_name string")
    assert pairs.classify(items, none, no_class, names).first().classification == vocab.GENERAL_LABEL


def test_nine_queries(spark):
    known = knowledge(spark, BASE)
    ids = spark.createDataFrame([("11289", "5640")], "rxcui_a string, rxcui_b string")
    rows = pairs.pair_queries(ids, pairs.drug_cards(known.drugs, known.terms())).orderBy("ord").collect()
    assert len(rows) == 9
    assert rows[0].query == "warfarin and ibuprofen interaction" and rows[4].query == "warfarin ibuprofen"
    assert [r.query_type for r in rows[5:]] == ["drug_a_specific"] * 2 + ["drug_b_specific"] * 2
    assert rows[5].scope == ["11289"] and rows[0].scope == ["11289", "5640"]


def test_shared_searches_run_once(spark):
    known = knowledge(spark, BASE)
    ids = spark.createDataFrame([("11289", "5640"), ("11289", "6809")], "rxcui_a string, rxcui_b string")
    queries = pairs.pair_queries(ids, pairs.drug_cards(known.drugs, known.terms()))
    # Both pairs ask the two warfarin queries.
    assert queries.count() - pairs.distinct_searches(queries).count() == 2


def test_top_k_is_exact_with_a_hot_scope_and_ties(spark):
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(400, 8)), 1)
    vectors[50:150] = vectors[0]
    scopes = ["hot"] * 300 + ["cold"] * 100
    chunks = spark.createDataFrame([(f"c{i:03d}", s, [float(x) for x in v]) for i, (s, v) in enumerate(zip(scopes, vectors, strict=True))],
                                   "chunk_id string, scope string, cvec array<double>")
    queries = chunks.limit(0)
    queries = spark.createDataFrame([(f"q{i}", s, [float(x) for x in vectors[i * 7]]) for i in range(40) for s in ("hot", "cold", "missing")],
                                    "query_id string, scope string, qvec array<double>")
    got = search.top_k(queries, chunks, 5, query_block=6, chunk_block=32).collect()
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append((r.rank, r.chunk_id, r.distance))
    for i in range(40):
        d = np.round(((vectors - vectors[i * 7]) ** 2).sum(1), 6)
        want = sorted((d[j], f"c{j:03d}") for j in range(400))[:5]
        mine = sorted(by_query[f"q{i}"])
        assert [m[1] for m in mine] == [w[1] for w in want]
        assert [m[2] for m in mine] == pytest.approx([w[0] for w in want])


def test_retrieve_filters_and_ignores_blank_queries(spark):
    known = knowledge(spark, BASE)
    index = known.index.withColumn("section_key", F.lit("warnings"))
    queries = spark.createDataFrame([("1", "dose"), ("2", "  ")], "query_id string, query_text string")
    rows = search.retrieve(queries, index, EMBED, k=2, rxcui=["11289"]).collect()
    assert {r.rxcui for r in rows} == {"11289"} and {r.query_id for r in rows} == {"1"}
    assert search.retrieve(queries, index, EMBED, section_key="other").count() == 0


def test_name_search_against_brute_force(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abc%_\\d ") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    terms = spark.createDataFrame([(i, i % 2, n) for i, n in enumerate(names)], "drug_id int, kind int, term string")
    asked = ["a", "ab", "abc", "%", "_", "a%c", "_b_", "", " a ", "\\", "ABC", "d%%d", "__", "zzz"]
    q = spark.createDataFrame([(a,) for a in asked], "query string")
    got = {(r["query"], r.drug_id) for r in resolve.search_names(q, terms).collect()}

    def like(text, pattern):
        import re

        return re.fullmatch("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern), text, re.DOTALL)

    want = {(a, i) for a in asked for i, n in enumerate(names) if like(n.lower(), "%" + a.strip().lower() + "%")}
    assert got == want


def test_vocabulary_match_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 9)))
    concepts = [(f"{i:03d}", word()) for i in range(80)]
    names = sorted({word() for _ in range(120)} | {"", "  ", "A-B", concepts[0][1].upper()})
    got = {r.name: r for r in resolve.match_vocabulary(
        spark.createDataFrame([(n,) for n in names], "name string"),
        spark.createDataFrame(concepts, "rxcui string, concept_name string")).collect()}

    def grams(s):
        s = f"  {s} "
        return {s[i:i + 3] for i in range(len(s) - 2)}

    for n in names:
        key = " ".join("".join(c if c.isalnum() else " " for c in n.lower()).split())
        exact = sorted(r for r, c in concepts if c == key and key)
        if exact:
            assert (got[n].match_type, got[n].rxcui) == ("exact", exact[0])
            continue
        scored = sorted((-round(200 * len(grams(key) & grams(c)) / (len(grams(key)) + len(grams(c))), 6), r) for r, c in concepts) if key else []
        scored = [(s, r) for s, r in scored if -s >= 50][:5]
        if scored:
            assert got[n].match_type == "approximate" and got[n].warning
            assert [got[n].rxcui] + [c.rxcui for c in got[n].other_candidates] == [r for _, r in scored], n
        else:
            assert got[n].match_type == "none" and got[n].rxcui is None


def test_failed_lookups_are_errors_not_misses(spark):
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    concepts = spark.createDataFrame([("1", "zzzz")], "rxcui string, concept_name string")
    broken = spark.createDataFrame([("a", "timed out")], "name string, error string")
    got = {r.name: r.match_type for r in resolve.with_lookup_errors(resolve.match_vocabulary(names, concepts), broken).collect()}
    assert got == {"a": "error", "b": "none"}


def test_retrieval_error_status(spark):
    resolved = spark.createDataFrame([("x", "y", "1", "2")], "drug_a string, drug_b string, rxcui_a string, rxcui_b string")
    counts = spark.createDataFrame([("1", "2", 1, 0)], "rxcui_a string, rxcui_b string, n_pair_specific int, n_supporting int")
    failed = spark.createDataFrame([("1", "2")], "rxcui_a string, rxcui_b string")
    assert pairs.pair_status(resolved, counts, failed).first().evidence_status == vocab.RETRIEVAL_ERROR


def test_status_labels_have_a_default(spark):
    df = spark.createDataFrame([(vocab.INSUFFICIENT,), ("odd",), (None,)], "evidence_status string")
    got = [(r.label, r.tone) for r in pairs.with_status_label(df).collect()]
    assert got == [("Insufficient evidence", "neutral"), ("odd", "neutral"), ("Unknown", "neutral")]


def test_blocks_of_equal_vectors_stay_small():
    vectors = lambda n: pa.array([[0.5, 1.0]] * n, pa.list_(pa.float64()))
    queries = pa.table({"query_id": [f"q{i}" for i in range(300)], "qvec": vectors(300)})
    chunks = pa.table({"chunk_id": [f"c{i:05d}" for i in np.random.default_rng(1).permutation(6000)], "cvec": vectors(6000)})
    tracemalloc.start()
    got = search._block_top_k(3, 6)(queries, chunks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 900 and set(got["chunk_id"].to_pylist()) == {"c00000", "c00001", "c00002"}
    assert got["chunk_id"].to_pylist()[:3] == ["c00000", "c00001", "c00002"]
    assert peak < 24 << 20


def test_runs_of_wildcards_settle_at_once(spark):
    texts = ["a" * 70, "a" * 70 + "q", "b" * 11 + "q", "b" * 12 + "q", "back\\slash_q%", None]
    terms = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "drug_id bigint, kind int, term string")
    asked = ["_%" * 12 + "q", "%_%", "k\\S", "a%a%%_q", "", "_%%_", "aaaaaq"]
    got = {(r.query, r.drug_id) for r in resolve.search_names(spark.createDataFrame([(a,) for a in asked], "query string"), terms).collect()}
    every = {0, 1, 2, 3, 4}
    want = {asked[0]: {1, 3}, "%_%": every, "k\\S": {4}, "a%a%%_q": {1, 4}, "": every, "_%%_": every, "aaaaaq": {1}}
    assert got == {(q, d) for q, ds in want.items() for d in ds}
