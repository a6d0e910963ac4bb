"""Write casts.json: which columns of each SQL answer need a cast. Run after adding a query.

    python -m checks.describe
"""

from __future__ import annotations

import json

import duckdb

from checks import oracle

INPUTS = {
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_orderdate TIMESTAMP, o_orderpriority VARCHAR",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_returnflag VARCHAR, l_linestatus VARCHAR, "
    "l_shipdate TIMESTAMP",
    "part": "p_partkey BIGINT, p_name VARCHAR, p_type VARCHAR, p_size INTEGER",
    "nation": "n_nationkey INTEGER, n_regionkey INTEGER",
}
TARGET = {"DATE": "VARCHAR", "INTEGER": "BIGINT", "HUGEINT": "BIGINT"}


def casts() -> dict[str, dict[str, str]]:
    con = duckdb.connect()
    for table, columns in INPUTS.items():
        con.execute(f"CREATE TABLE {table} ({columns})")
    out = {}
    for name in oracle.QUERIES:
        described = con.execute(f"DESCRIBE {oracle.raw_sql(name)}").fetchall()
        found = {column: TARGET[kind] for column, kind, *_ in described if kind in TARGET}
        if found:
            out[name] = found
    return out


if __name__ == "__main__":
    oracle.CASTS_FILE.write_text(json.dumps(casts(), indent=1, sort_keys=True) + "\n")
