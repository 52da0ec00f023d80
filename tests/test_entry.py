import __spark_entry__ as entry


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"p2_found", "p3_found", "p5_found"} <= set(queries)
    assert entry.entry(spark).columns == ["user_id", "session_start", "session_end", "n_episodes"]
