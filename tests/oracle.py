"""Compare a query's rows with those of its DuckDB twin."""

from __future__ import annotations

from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
DATA = "/root/testdata/sf0.001"


def connect(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES.split():
        path = Path(sf_dir, f"{name}.parquet")
        files = path / "*.parquet" if path.is_dir() else path
        db.execute(f"create view {name} as select * from '{files}'")
    return db


def assert_same(found: DataFrame, statement: str, sf_dir: str = DATA) -> None:
    db = connect(sf_dir)
    expected = db.sql(statement).to_arrow_table()
    actual = found.toArrow()
    assert sorted(actual.column_names) == sorted(expected.column_names)
    names = ", ".join(f'"{c}"' for c in sorted(expected.column_names))
    db.register("actual", actual)
    db.register("expected", expected)
    assert actual.num_rows == expected.num_rows
    for one, other in (("actual", "expected"), ("expected", "actual")):
        assert db.sql(f"select {names} from {one} except all select {names} from {other}").fetchall() == []
