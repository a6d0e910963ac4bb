from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oncolens.session import build_session  # noqa: E402
from oncolens.sources.tables import SCHEMAS  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "oncolens-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("stages")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def table(spark):
    """Rows of a declared table from dicts; dates may be ISO text, absent columns are null."""

    def make(name: str, *rows: dict):
        schema = SCHEMAS[name]
        dates = {f.name for f in schema if f.dataType.simpleString() == "date"}

        def value(row, column):
            v = row.get(column)
            return dt.date.fromisoformat(v) if column in dates and isinstance(v, str) else v

        return spark.createDataFrame([tuple(value(r, f.name) for f in schema) for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def frame(spark):
    """A small DataFrame from a DDL schema; date columns may be given as ISO text."""

    def make(schema: str, *rows: tuple):
        columns = [c.strip().split(" ") for c in schema.split(",")]
        text = ", ".join(f"{n} {'string' if k == 'date' else k}" for n, k in columns)
        df = spark.createDataFrame(list(rows), text)
        return df.selectExpr(*[f"CAST({n} AS {k}) AS {n}" for n, k in columns])

    return make


def as_set(df, *columns):
    return {tuple(str(v) if isinstance(v, dt.date) else v for v in r) for r in df.select(*columns).collect()}


@pytest.fixture(scope="session")
def rows_of():
    return as_set
