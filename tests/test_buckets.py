"""Bucketed tables and loads that touch only their buckets, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from pairlight.functions.vectors import HashEmbedder
from pairlight.sources import tables
from pairlight.sources.buckets import BucketTable
from pairlight.streaming import buckets as loads
from pairlight.streaming import ingest as stream
from test_load import sources

SCHEMA = "id string, rxcui string, text string, v array<double>"
EMBED = HashEmbedder(16)


@pytest.fixture
def table(spark, tmp_path):
    return BucketTable(spark, str(tmp_path / "t"), SCHEMA, "id", "rxcui", 5)


def rows(spark, kept):
    return spark.createDataFrame([(i, r, t, [1.0] if t else None) for (i, r), t in kept.items()], SCHEMA)


def content(df):
    return sorted((r.id, r.rxcui or "", r.text or "") for r in df.collect())


def want(kept):
    return sorted((i, r or "", t or "") for (i, r), t in kept.items())


def test_changes_in_any_order(spark, table):
    rnd = random.Random(4)
    assert content(table.read()) == [] and table.version() is None
    kept, history = {}, []
    for step in range(9):
        keys = [(f"i{k}", None if k % 11 == 0 else f"r{k % 7}") for k in rnd.sample(range(40), 12)]
        if step % 3 == 2:
            table.delete(rows(spark, dict.fromkeys(keys)))
            kept = {k: t for k, t in kept.items() if k not in keys}
        else:
            new = {k: f"{step}-{k[0]}" for k in keys}
            table.put(rows(spark, new))
            kept = {**kept, **new}
        if step == 4:
            table.compact([0, 1, 2])
        history.append((table.version(), dict(kept)))
        assert content(table.read()) == want(kept)
    for version, was in history:
        assert content(table.read(version)) == want(was)
    table.compact()
    assert content(table.read()) == want(kept)
    assert {s["kind"] for s in table.manifest()} <= {"base"}
    assert content(table.by_values(["r1", "r2"])) == want({k: t for k, t in kept.items() if k[1] in ("r1", "r2")})
    assert "base" in table.describe()


def test_only_wanted_buckets_are_opened(spark, table):
    table.put(rows(spark, {(f"i{k}", f"r{k}"): "t" for k in range(30)}))
    wanted = table.touched(spark.createDataFrame([("r3",)], "rxcui string"))
    files = table.by_values(["r3"]).inputFiles()
    assert len(wanted) == 1 and files and all(f"_bucket={wanted[0]}/" in f for f in files)


def test_filtered_reads_of_some_columns(spark, table):
    """Rows that a filter leaves out are merged by their id; their older forms, which it would take, do not come back."""
    table.put(rows(spark, {(f"i{k}", f"r{k % 7}"): "old" for k in range(30)}))
    table.compact([0, 1])
    table.put(rows(spark, {(f"i{k}", f"r{k % 7}"): "new" for k in range(5, 15)} | {("i40", "r1"): None}))
    table.delete(rows(spark, {("i1", "r1"): None}))
    for text in ("old", "new"):
        found = table.read(where=F.col("text") == text, columns=["id", "rxcui"])
        assert found.columns == ["id", "rxcui"]
        assert sorted(map(tuple, found.collect())) == sorted((r.id, r.rxcui) for r in table.read().collect() if r.text == text)
    assert sorted(r.id for r in table.by_values(["r1"], columns=["id"]).collect()) == sorted(r.id for r in table.read().collect() if r.rxcui == "r1")
    assert table.read(0, where=F.col("text") == "old", columns=["id"]).count() == 30
    plan = table.read(where=F.col("text") == "old", columns=["id"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "v:array" not in plan


def test_rewrite_leaves_other_files_alone(spark, table):
    table.put(rows(spark, {(f"i{k}", f"r{k}"): "t" for k in range(30)}))
    before = {s["bucket"]: s["folder"] for s in table.manifest()}
    version = table.rewrite(table.read(buckets=[1, 3]).withColumn("text", F.lit("new")), [1, 3])
    after = {s["bucket"]: s["folder"] for s in table.manifest(version)}
    assert {b for b in before if before[b] != after[b]} == {1, 3}
    assert table.read().where("text = 'new'").count() == table.read(0, [1, 3]).count()
    with pytest.raises(Exception, match="bucket that is not written"):
        table.rewrite(table.read(), [1])
    assert table.version() == version and table.read().count() == 30


def test_a_change_that_broke_off_does_not_count(spark, table, tmp_path):
    table.put(rows(spark, {("a", "r"): "1"}))
    rows(spark, {("b", "r"): "2"}).write.parquet(f"{table.folder}/data/1-put/_bucket=0")  # without a manifest
    assert content(table.read()) == [("a", "r", "1")] and table.version() == 0
    table.put(rows(spark, {("c", "r"): "3"}))
    assert content(table.read()) == [("a", "r", "1"), ("c", "r", "3")]


def test_loads_by_bucket(spark, tmp_path):
    store = loads.BucketStore(spark, str(tmp_path / "store"), 7)
    texts = {"w2": "Avoid NSAIDs."}
    batch = lambda *names: spark.createDataFrame(list(enumerate(names)), "pos bigint, name string")
    assert store.load_batch(batch("warfarin", "nobody"), 0, sources(spark, texts), EMBED) == 0
    assert {r.name: r.drug_status for r in spark.read.parquet(f"{store.folder}/reports/version=0").collect()} == {"warfarin": "added", "nobody": "failed"}
    assert store.load_batch(batch("Warfarin", "ibuprofen"), 1, sources(spark, texts), EMBED) == 1
    assert store.load_batch(batch("Warfarin", "ibuprofen"), 1, sources(spark, texts), EMBED) == 1  # done before
    assert {r.rxcui for r in store.read("drugs", 1).collect()} == {"11289", "5640"} and store.read("drugs", 0).count() == 1
    assert store.read("chunk_index", 1).count() == 2 and store.read("label_sections", 1).count() == 14
    new = store.read("drugs", 1).where("rxcui = '5640'")
    for name, by in (("drugs", new), ("drug_synonyms", new), ("chunk_index", new)):
        t = store.table(name)
        touched = set(t.touched(by))
        assert [s for s in t.manifest(0) if s["bucket"] not in touched] == [s for s in t.manifest(1) if s["bucket"] not in touched]
    # a batch that finds nothing new still leaves a complete version
    assert store.load_batch(batch("warfarin"), 2, sources(spark, texts), EMBED) == 2
    assert {n: store.read(n, 2).count() for n in loads.LAYOUT} == {n: store.read(n, 1).count() for n in loads.LAYOUT}


def test_streamed_loads(spark, tmp_path):
    names = tmp_path / "names"
    names.mkdir()
    store = loads.BucketStore(spark, str(tmp_path / "store"), 3)
    run = lambda cp: loads.start(stream.read_names(spark, str(names)), store, str(tmp_path / cp), lambda: sources(spark, {"w2": "Avoid NSAIDs."}), EMBED).awaitTermination()
    (names / "1.json").write_text('{"pos": 1, "name": "warfarin"}\n')
    run("cp")
    (names / "2.json").write_text('{"pos": 2, "name": "Warfarin"}\n{"pos": 3, "name": "ibuprofen"}\n')
    run("cp")
    assert store.latest() == 1 and store.read("drugs", 1).count() == 2
    assert tables.commits(spark, store.folder).count() == 2
