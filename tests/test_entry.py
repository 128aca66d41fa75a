"""The driver's contract."""

import __spark_entry__


def test_every_sql_has_its_query():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and "flagstat_counts" in queries and all(map(callable, queries.values()))
