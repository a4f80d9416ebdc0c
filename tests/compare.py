"""Spark results against DuckDB on the same tables, whatever the order of rows and columns."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from pathlib import Path

DATA = Path(os.environ.get("GRIDLOOM_TEST_DATA", "/root/testdata/sf0.001"))


def plain(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def spark_rows(frame) -> tuple[list[str], list[tuple]]:
    names = sorted(frame.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in frame.select(*names).collect()), key=repr)


def duck_rows(sql: str, folder: Path = DATA) -> tuple[list[str], list[tuple]]:
    import duckdb

    con = duckdb.connect()
    for path in sorted(folder.glob("*.parquet")):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{source}')")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in found.fetchall()), key=repr)
