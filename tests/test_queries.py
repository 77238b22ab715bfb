import __spark_entry__ as entry


def test_every_query_has_sql():
    assert set(entry.registry.QUERIES) == set(entry.registry.ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_query(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["regimen_id", "total_pairs"]
    rows = df.collect()
    assert rows and all(1 <= r.total_pairs <= 45 for r in rows)
    assert all(r.n_pair_specific + r.n_supporting + r.n_insufficient + r.n_not_found + r.n_invalid + r.n_error == r.total_pairs for r in rows)
