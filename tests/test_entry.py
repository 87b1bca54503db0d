import __spark_entry__ as e


def test_registry():
    names, sql = e.queries(), e.oracle_sql()
    assert len(names) > 100 and set(sql) <= set(names)


def test_entry_runs(spark):
    rows = e.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "chunk", "score", "n_terms"}
