import dataclasses
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlight import vocab
from pairlight.functions.vectors import HashEmbedder
from pairlight.operators import candidates, index, upsert
from pairlight.plans import ingest as plan
from pairlight.plans import pair_evidence as pe
from pairlight.sources import label_xml, tables, vocabulary
from pairlight.streaming import ingest as stream

EMBED = HashEmbedder(16)
NS = vocab.LABEL_NAMESPACE


def section(code, text, inner=""):
    body = "" if text is None else f"<text><paragraph>{text}</paragraph></text>"
    return f'<component><section><code code="{code}"/><title>x</title>{body}{inner}</section></component>'


def label(setid, *sections, version="3", maker="Acme"):
    return (f'<document xmlns="{NS}"><setId root="{setid}"/><versionNumber value="{version}"/><title>Label {setid}</title>'
            f"<author><assignedEntity><representedOrganization><name> {maker} </name></representedOrganization></assignedEntity></author>"
            f'<effectiveTime value="20240101"/><component><structuredBody>{"".join(sections)}</structuredBody></component></document>')


def parse(spark, docs):
    df = spark.createDataFrame(list(docs.items()), "doc string, xml string")
    return {r.doc: r for r in label_xml.parse_labels(df).collect()}


def test_label_documents(spark):
    got = parse(spark, {
        "full": label("s1", section("34073-7", "Do  not\n mix."), section("34070-3", ".")),
        "nested": label("s2", section("00000-0", "outer", section("34073-7", "inner"))),
        "twice": label("s3", section("34073-7", "N/A"), section("34073-7", "real"), section("34073-7", "later")),
        "broken": "<document><oops></document>",
        "bare": f'<document xmlns="{NS}"/>',
        "deep": label("s4", section("34073-7", None, section("99999-9", "only the inner text"))),
    })
    pick = lambda doc: {s.section_key: s for s in got[doc].sections}
    assert len(got["full"].sections) == 7
    assert pick("full")["drug_interactions"].text == "Do not mix." and pick("full")["drug_interactions"].found
    assert pick("full")["contraindications"].text == "" and not pick("full")["contraindications"].found
    assert (got["full"].setid, got["full"].spl_version, got["full"].title, got["full"].manufacturer, got["full"].effective_time) == (
        "s1", "3", "Label s1", "Acme", "20240101")
    assert pick("nested")["drug_interactions"].text == "inner"
    assert pick("twice")["drug_interactions"].text == "real"
    assert got["broken"].error and got["broken"].sections is None
    assert got["bare"].error is None and not any(s.found for s in got["bare"].sections) and got["bare"].setid is None
    assert not pick("deep")["drug_interactions"].found


def test_label_files_and_responses(spark, tmp_path):
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml" / "a.xml").write_text(label("s1", section("34073-7", "line one\nline two")))
    rows = label_xml.section_rows(label_xml.parse_labels(label_xml.read_label_files(spark, str(tmp_path / "xml"))))
    assert rows.where("found").count() == 1 and rows.count() == 7
    (tmp_path / "r.json").write_text(json.dumps({"allRelatedGroup": {"rxcui": "1", "conceptGroup": [
        {"tty": "IN", "conceptProperties": [{"rxcui": "1", "name": "warfarin", "tty": "IN"}]}, {"tty": "BN"}]}}) + "\n")
    read = vocabulary.read_responses(spark, str(tmp_path / "r.json"), vocabulary.RELATED)
    related = read.select(F.lit("1").alias("rxcui"), F.struct("allRelatedGroup").alias("response"))
    assert [(r.tty, r.name) for r in vocabulary.related_rows(related).orderBy("group_pos").collect()] == [("IN", "warfarin"), ("BN", None)]


def test_vocabulary_answers(spark):
    one = lambda body, schema, f: vocabulary.parse_responses(
        spark.createDataFrame([(json.dumps(body),)], "b string"), "b", schema).select(f(F.col("response")).alias("x")).first().x
    assert one({"idGroup": {"name": "a", "rxnormId": ["7", "8"]}}, vocabulary.EXACT, vocabulary.exact_id) == "7"
    assert one({"idGroup": {}}, vocabulary.EXACT, vocabulary.exact_id) is None
    assert one({"propConceptGroup": {"propConcept": [{"propName": "n", "propValue": "v"}]}}, vocabulary.PROPERTY, vocabulary.canonical_name) == "v"
    body = {"approximateGroup": {"candidate": [{"rxcui": "1", "score": "90"}, {"rxcui": "2", "score": "x"}, {"rxcui": "3", "score": "10"}, {"score": "99"}]}}
    got = one(body, vocabulary.APPROXIMATE, lambda r: vocabulary.approximate_candidates(r, 50.0))
    assert [(c.rxcui, c.score) for c in got] == [("1", 90.0)]


def test_best_candidate(spark):
    rows = [("a", 1, False), ("a", 2, True), ("a", 3, True), ("b", 1, False), ("b", 2, False), ("c", 1, False), ("c", 2, False), ("c", 3, False), ("c", 4, True)]
    got = {r.k: r for r in candidates.best_candidate(spark.createDataFrame(rows, "k string, at int, hit boolean"), "k", ["at"], "hit").collect()}
    view = {k: (r["at"], r.candidates_checked, r.total_candidates_found, r.evidence_status) for k, r in got.items()}
    assert view == {"a": (2, 2, 3, "interaction_evidence_found"), "b": (1, 2, 2, "label_found_no_interaction_section"),
                    "c": (1, 3, 4, "label_found_no_interaction_section")}


def test_upsert_matches_null_keys_and_moves_times(spark):
    schema = "k string, v string, a string, b string, updated_at timestamp"
    old = spark.createDataFrame([("1", None, "x", "keep", None), ("2", "1", "x", "keep", None), ("3", "1", "x", "keep", None)], schema)
    new = spark.createDataFrame([("1", None, "x", "new", None), ("2", "1", None, "new", None), ("4", "1", "y", "new", None)], schema)
    now = F.lit("2024-01-01").cast("timestamp")
    got = {r.k: r for r in upsert.upsert(old, new, ["k", "v"], ["a"], now).collect()}
    assert {k: r.status for k, r in got.items()} == {"1": "unchanged", "2": "updated", "3": None, "4": "added"}
    assert got["1"].updated_at is None and got["2"].updated_at is not None and got["2"].a is None
    assert got["2"].b == "keep" and got["4"].b == "new" and got["3"].a == "x"


def sources(spark, texts):
    concepts = spark.createDataFrame([("11289", "warfarin"), ("5640", "ibuprofen"), ("7", "aspirin")], "rxcui string, concept_name string")
    related = spark.createDataFrame([("11289", "IN", ["Coumadin"], "warfarin", ["warfarin 5 mg"])],
                                    "rxcui string, term_type string, brand_names array<string>, generic_name string, synonyms array<string>")
    found = spark.createDataFrame([
        ("11289", 1, "w1", "1", "W one", "d"), ("11289", 2, "w2", "1", "W two", "d"), ("5640", 1, "i1", "1", "I one", "d"),
        ("5640", 2, "gone", "1", "missing", "d"),
    ], "rxcui string, rank int, setid string, spl_version string, title string, published_date string")
    docs = {"w1": label("w1", section("34070-3", "Not with others.")), "w2": label("w2", section("34073-7", texts["w2"])),
            "i1": label("i1", section("34073-7", "Bleeding with warfarin."))}
    parsed = label_xml.parse_labels(spark.createDataFrame(list(docs.items()), "doc string, xml string"))
    return plan.Sources(concepts, related, found, parsed)




def load(spark, store, names, texts):
    table = spark.createDataFrame(list(enumerate(names)), "pos bigint, name string")
    after, report = plan.ingest(table, store, sources(spark, texts), F.lit("2024-01-01").cast("timestamp"))
    return after, {r.name: r for r in report.collect()}


def test_load_twice_then_changed(spark, tmp_path):
    texts = {"w2": "Avoid NSAIDs."}
    after, report = load(spark, plan.Store.empty(spark), ["warfarin", "Ibuprofen", "zzzzqq", "aspirin"], texts)
    assert {n: (r.drug_status, r.evidence_status) for n, r in report.items()} == {
        "warfarin": ("added", "interaction_evidence_found"), "Ibuprofen": ("added", "interaction_evidence_found"),
        "zzzzqq": ("failed", None), "aspirin": ("added", "no_label_found")}
    assert report["warfarin"].sections_added == 7 and report["aspirin"].sections_added == 0
    after.write(str(tmp_path), 0)
    first = plan.Store.read(spark, str(tmp_path), 0)
    assert first.drugs.count() == 3 and first.labels.count() == 2 and first.label_sections.count() == 14
    assert first.drug_synonyms.count() == 2 and first.drug_label_links.count() == 2
    label_row = first.labels.where("setid = 'w2'").first()
    assert label_row.manufacturer == "Acme" and label_row.spl_version == "3"

    again, report = load(spark, first, ["warfarin", "Ibuprofen"], texts)
    assert {(r.drug_status, r.label_status, r.link_status, r.sections_unchanged) for r in report.values()} == {("unchanged",) * 3 + (7,)}
    again.write(str(tmp_path), 1)
    second = plan.Store.read(spark, str(tmp_path), 1)
    for name in ("drugs", "labels", "label_sections", "drug_synonyms", "drug_label_links"):
        assert getattr(second, name).count() == getattr(first, name).count()

    _, report = load(spark, second, ["warfarin"], {"w2": "Avoid NSAIDs and more."})
    assert (report["warfarin"].drug_status, report["warfarin"].sections_updated, report["warfarin"].sections_unchanged) == ("unchanged", 1, 6)


def test_unreadable_candidate_before_a_hit_is_an_error(spark):
    found = spark.createDataFrame([("a", 1, "bad", "1", "t", "d"), ("a", 2, "ok", "1", "t", "d"), ("b", 1, "ok", "1", "t", "d"), ("b", 2, "bad", "1", "t", "d")],
                                  "rxcui string, rank int, setid string, spl_version string, title string, published_date string")
    docs = label_xml.parse_labels(spark.createDataFrame([("bad", "<x"), ("ok", label("ok", section("34073-7", "text")))], "doc string, xml string"))
    got = {r.rxcui: r.evidence_status for r in plan.choose_labels(found, docs).collect()}
    assert got == {"a": "error", "b": "interaction_evidence_found"}


def small_store(spark, text, found=True):
    s = tables.SCHEMAS
    return plan.Store(
        tables.conform(spark.createDataFrame([(1, "11289", "warfarin")], "drug_id bigint, rxcui string, normalized_name string"), "drugs"),
        tables.empty(spark, "drug_synonyms"),
        tables.conform(spark.createDataFrame([(10, "s", "1")], "label_id bigint, setid string, spl_version string"), "labels"),
        spark.createDataFrame([(100, 10, "drug_interactions", "34073-7", "Drug Interactions", text, found, None)], s["label_sections"]),
        spark.createDataFrame([(1000, 1, 10, "interaction_evidence_found", 1, 1, None)], s["drug_label_links"]),
    )


def rows_and_report(store, old, **kw):
    rows, report = plan.build_index(store, old, EMBED, **kw)
    return rows, report.first()


def test_index_runs(spark):
    words = " ".join(f"w{i}" for i in range(400))
    empty = tables.empty(spark, "chunk_index")
    rows, first = rows_and_report(small_store(spark, words), empty)
    n = rows.count()
    assert (first.drugs_processed, first.sections_processed, first.chunks_added) == (1, 1, n) and n > 1
    same, second = rows_and_report(small_store(spark, words), rows)
    assert (second.chunks_added, second.chunks_unchanged, same.count()) == (0, n, n)
    short, third = rows_and_report(small_store(spark, "only three words"), rows)
    assert (third.chunks_updated, third.chunks_deleted_stale, short.count()) == (1, n - 1, 1)
    row = short.first()
    assert row.chunk_id == "link-1000-section-100-chunk-0" and row.embedding == pytest.approx(
        EMBED(spark.createDataFrame([("only three words",)], "t string"), "t", "v").first().v)
    blank, report = rows_and_report(small_store(spark, "  "), empty)
    assert (report.malformed_records_skipped, blank.count()) == (1, 0)


def test_sections_that_are_no_longer_found_keep_their_chunks_unless_asked(spark):
    rows, _ = rows_and_report(small_store(spark, "some text that is indexed"), tables.empty(spark, "chunk_index"))
    kept, report = rows_and_report(small_store(spark, "", found=False), rows)
    assert kept.count() == 1 and report.chunks_deleted_stale == 0
    diff = index.index_diff(rows, rows.limit(0).drop("embedding"), delete_unvisited=True)
    assert [r.status for r in diff.collect()] == ["deleted"]


def test_put_and_delete_chunks(spark):
    rows, _ = rows_and_report(small_store(spark, "some text that is indexed"), tables.empty(spark, "chunk_index"))
    other = rows.withColumn("text", F.lit("new"))
    assert [r.text for r in tables.put_chunks(rows, other).collect()] == ["new"]
    assert tables.without_ids(rows, rows).count() == 0 and tables.by_ids(rows, rows).count() == 1


def test_streamed_load_is_idempotent(spark, tmp_path):
    names = tmp_path / "names"
    names.mkdir()
    (names / "1.json").write_text('{"pos": 1, "name": "warfarin"}\n{"pos": 2, "name": "nobody"}\n')
    folder, checkpoint = str(tmp_path / "store"), str(tmp_path / "cp")
    load_from = lambda: sources(spark, {"w2": "Avoid NSAIDs."})
    run = lambda cp: stream.start(stream.read_names(spark, str(names)), folder, cp, load_from, EMBED).awaitTermination()
    run(checkpoint)
    assert tables.latest(spark, folder) == 0
    assert tables.read_snapshot(spark, folder, "drugs", 0).count() == 1
    assert tables.read_snapshot(spark, folder, "chunk_index", 0).count() == 1
    report = {r.name: r.drug_status for r in spark.read.parquet(f"{folder}/reports/version=0").collect()}
    assert report == {"warfarin": "added", "nobody": "failed"}
    (names / "2.json").write_text('{"pos": 3, "name": "Warfarin"}\n{"pos": 4, "name": "ibuprofen"}\n')
    run(checkpoint)
    drugs = tables.read_snapshot(spark, folder, "drugs", 1)
    assert {r.rxcui for r in drugs.collect()} == {"11289", "5640"}
    assert tables.read_snapshot(spark, folder, "chunk_index", 1).count() == 2
    batch = spark.createDataFrame([(3, "Warfarin"), (4, "ibuprofen")], "pos bigint, name string")
    assert stream.load_batch(spark, batch, folder, 1, load_from(), EMBED, run=checkpoint) == 1
    assert tables.latest(spark, folder) == 1
    # a fresh checkpoint goes on from what is there
    run(str(tmp_path / "other"))
    assert tables.latest(spark, folder) == 2
    assert {r.rxcui for r in tables.read_snapshot(spark, folder, "drugs", 2).collect()} == {"11289", "5640"}
    assert tables.read_snapshot(spark, folder, "drugs", 0).count() == 1


def test_stream_goes_on_from_a_loaded_store(spark, tmp_path):
    after, _ = load(spark, plan.Store.empty(spark), ["warfarin"], {"w2": "Avoid NSAIDs."})
    after.write(str(tmp_path), 0)
    batch = spark.createDataFrame([(1, "ibuprofen")], "pos bigint, name string")
    assert stream.load_batch(spark, batch, str(tmp_path), 0, sources(spark, {"w2": "Avoid NSAIDs."}), EMBED) == 1
    assert tables.read_snapshot(spark, str(tmp_path), "drugs", 1).count() == 2
    assert tables.read_snapshot(spark, str(tmp_path), "chunk_index", 1).count() == 2


def test_load_feeds_the_retrieval(spark):
    after, _ = load(spark, plan.Store.empty(spark), ["warfarin", "Ibuprofen"], {"w2": "Avoid NSAIDs with warfarin."})
    rows, _ = plan.build_index(after, tables.empty(spark, "chunk_index"), EMBED)
    known = pe.Knowledge.of_store(after, rows)
    assert {(r.term, r.ord) for r in known.terms().where("rxcui = '11289'").collect()} == {("warfarin", 0), ("Coumadin", 1), ("warfarin 5 mg", 2)}
    resolved = pe.resolve_pairs(spark.createDataFrame([("Coumadin", "ibuprofen")], "drug_a string, drug_b string"), known)
    evidence = pe.evidence_for(pe.searchable(resolved), known, EMBED)
    assert [r.evidence_status for r in pe.statuses_for(resolved, evidence).collect()] == [vocab.PAIR_FOUND]


def test_label_files_are_found_by_set_id_and_empty_values_fall_back(spark, tmp_path):
    (tmp_path / "w1.xml").write_text(label("", section("34073-7", "text"), version="").replace("Label ", ""))
    docs = label_xml.parse_labels(label_xml.read_label_files(spark, str(tmp_path)))
    found = spark.createDataFrame([("11289", 1, "w1", "7", "Candidate title", "d")], "rxcui string, rank int, setid string, spl_version string, title string, published_date string")
    concepts = spark.createDataFrame([("11289", "warfarin")], "rxcui string, concept_name string")
    related = spark.createDataFrame([], "rxcui string, term_type string, brand_names array<string>, generic_name string, synonyms array<string>")
    names = spark.createDataFrame([(0, "warfarin")], "pos bigint, name string")
    after, _ = plan.ingest(names, plan.Store.empty(spark), plan.Sources(concepts, related, found, docs), F.lit("2024-01-01").cast("timestamp"))
    row = after.labels.first()
    assert (row.setid, row.spl_version, row.title, after.label_sections.where("found").count()) == ("w1", "7", "Candidate title", 1)


def test_index_report_counts_drugs_without_chunks(spark):
    store = small_store(spark, "x")
    more = plan.Store(store.drugs.unionByName(tables.conform(spark.createDataFrame([(2, "5640", "ibuprofen")], "drug_id bigint, rxcui string, normalized_name string"), "drugs")),
                      store.drug_synonyms, store.labels.unionByName(tables.conform(spark.createDataFrame([(20, "t", "1")], "label_id bigint, setid string, spl_version string"), "labels")),
                      store.label_sections, store.drug_label_links.unionByName(spark.createDataFrame([(2000, 2, 20, "interaction_evidence_found", 1, 1, None)], tables.SCHEMAS["drug_label_links"])))
    _, report = rows_and_report(more, tables.empty(spark, "chunk_index"))
    assert (report.drugs_processed, report.sections_processed, report.skipped_empty_sections) == (2, 1, 0)


def test_unvisited_sections_are_not_compared(spark):
    rows, _ = rows_and_report(small_store(spark, "some text that is indexed"), tables.empty(spark, "chunk_index"))
    other = rows.withColumns({"chunk_id": F.lit("z"), "db_record_id": F.lit(7).cast("bigint")})
    diff = {r.chunk_id: r.status for r in index.index_diff(rows.unionByName(other), rows.drop("embedding")).collect()}
    assert diff == {"z": None, rows.first().chunk_id: "unchanged"}


def test_broken_lookup_is_reported_as_such(spark):
    given = sources(spark, {"w2": "Avoid NSAIDs."})
    errors = spark.createDataFrame([("warfarin", "timeout"), ("warfarin", "timeout")], "name string, error string")
    table = spark.createDataFrame([(0, "warfarin"), (1, "zzzzqq")], "pos bigint, name string")
    after, report = plan.ingest(table, plan.Store.empty(spark), dataclasses.replace(given, errors=errors), F.lit("2024-01-01").cast("timestamp"))
    got = {r.name: (r.match_type, r.drug_status, r.error, r.warning) for r in report.collect()}
    assert got == {"warfarin": ("error", "failed", "timeout", vocab.LOOKUP_FAILED), "zzzzqq": ("none", "failed", None, None)}
    assert after.drugs.count() == 0


def test_two_new_rows_with_one_key_are_an_error(spark):
    old = spark.createDataFrame([], "k string, a string, updated_at timestamp")
    new = spark.createDataFrame([("1", "x"), ("1", "y")], "k string, a string")
    with pytest.raises(Exception, match="more than one new row"):
        upsert.upsert(old, new, ["k"], ["a"]).collect()


def test_few_parsed_documents_are_held():
    good = f'<document xmlns="{vocab.LABEL_NAMESPACE}"><setId root="s"/><title>t</title></document>'
    batch = pa.RecordBatch.from_arrays([pa.array([f"d{i}" for i in range(200)]), pa.array([good, "<broken", None, good] * 50)], names=["doc", "xml"])
    made = list(label_xml._parse(iter([batch])))
    assert max(b.num_rows for b in made) <= 64
    rows = [r for b in made for r in b.to_pylist()]
    assert [r["doc"] for r in rows] == [f"d{i}" for i in range(200)]
    assert [(r["ok"], r["setid"], r["title"], r["sections"]) for r in rows[:3]] == [(True, "s", "t", []), (False, None, None, None), (False, None, None, None)]


def test_index_diff_reads_the_old_index_once(spark, tmp_path, capsys):
    schema = "chunk_id string, link_id bigint, db_record_id bigint, text string"
    old = [("a", 1, 1, "x"), ("b", 1, 1, "y"), ("c", 2, 1, "z"), ("d", None, 1, "n"), ("e", 3, 1, "moved")]
    new = [("a", 1, 1, "x"), ("f", 1, 1, "w"), ("e", 4, 1, "moved"), (None, 1, 1, "v")]
    for name, rows in (("old", old), ("new", new)):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    diff = index.index_diff(*(spark.read.parquet(f"{tmp_path}/{n}") for n in ("old", "new")))
    assert sorted((tuple(r) for r in diff.select("chunk_id", "link_id", "status").collect()), key=str) == sorted([
        ("a", 1, "unchanged"), ("b", 1, "deleted"), ("c", 2, None), ("d", None, None), ("e", 3, None), ("e", 4, "added"), ("f", 1, "added"), (None, 1, "added")], key=str)
    capsys.readouterr()
    diff.explain()
    assert capsys.readouterr().out.count(f"{tmp_path}/old") == 1
