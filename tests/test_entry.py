import __spark_entry__ as entry


def test_every_oracle_belongs_to_a_query():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) >= 70
    assert all(callable(q) for q in queries.values())


def test_flagship_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["query_id", "rank", "document_id"] and df.count() > 0
