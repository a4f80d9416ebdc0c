"""Every registered query with SQL gives DuckDB's rows."""

import pytest
from compare import DATA, duck_rows, spark_rows

from gridloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, name):
    names, rows = spark_rows(registry.QUERIES[name](spark, str(DATA)))
    wanted_names, wanted = duck_rows(registry.ORACLE_SQL[name])
    assert names == wanted_names
    assert len(rows) == len(wanted)
    assert rows == wanted
    assert rows or name in {"q_split_leakage", "q_unused_maps"}


def test_every_query_has_sql():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"q_scene_manifest"}
