"""What counts as a test."""

import duckdb

from quillgraph.operators.catalog import CATALOG


def test_only_functions_of_tests_are_tests(spark):
    query = CATALOG["untested-by-file-aggregated"]
    symbols = [("app/a().", "app/a.py"), ("app/b().", "app/a.py"), ("app/c().", "app/c.py"), ("x/tests/test_a().", "x/tests/test_a.py")]
    tables = {
        "Function": spark.createDataFrame(symbols, "symbol string, file string"),
        "TEST_FOR": spark.createDataFrame([("x/tests/test_a().", "app/a()."), ("app/a().", "app/b()."), ("app/a().", "app/c().")], "src string, dst string"),
    }
    got = [tuple(r) for r in query.example(tables).collect()]
    engine = duckdb.connect()
    engine.sql("CREATE TABLE \"Function\" AS SELECT * FROM (VALUES " + ", ".join(map(str, symbols)) + ") AS v(symbol, file)")
    engine.sql("CREATE TABLE \"TEST_FOR\" AS SELECT * FROM (VALUES ('x/tests/test_a().', 'app/a().'), ('app/a().', 'app/b().'), ('app/a().', 'app/c().')) AS v(src, dst)")
    assert got == engine.sql(query.plan().sql()).fetchall() == [("app/a.py", 1), ("app/c.py", 1)]
