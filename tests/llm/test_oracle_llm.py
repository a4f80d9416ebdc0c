"""The training-data queries with SQL give DuckDB's rows."""

import pytest
from compare import DATA, duck_rows, spark_rows

from gridloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    names, rows = spark_rows(queries.QUERIES[name](spark, str(DATA)))
    wanted_names, wanted = duck_rows(queries.ORACLE_SQL[name])
    assert names == wanted_names and rows == wanted and rows
