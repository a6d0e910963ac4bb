"""Every registered query against its SQL twin, and the shape of its plan."""

from __future__ import annotations

import os
from collections import Counter

import pytest

import __spark_entry__ as driver
from checks import describe, oracle
from oncolens.plans import registry
from tests.conftest import SF

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow")


def check(spark, con, name, sf_dir):
    df = driver.queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in FORBIDDEN if node in plan]
    columns = sorted(df.columns)
    got = Counter(tuple(row[c] for c in columns) for row in df.collect())
    answer = con.execute(oracle.sql(name))
    found = [d[0] for d in answer.description]
    assert sorted(found) == columns
    at = [found.index(c) for c in columns]
    want = Counter(tuple(row[i] for i in at) for row in answer.fetchall())
    assert got == want
    return got


# The single counts repeat receptor_report one condition at a time; ONCOLENS_FULL=1 runs them too.
SINGLE_COUNTS = {n for n in registry.ALL if any(group in n for group in registry.RECEPTOR_GROUPS)}
NAMES = [n for n in registry.ALL if os.environ.get("ONCOLENS_FULL") or n not in SINGLE_COUNTS]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    check(spark, duck, name, SF)


# Per order (key, patient) the suppliers of its lines: a day to change, one score missing, a conflict, a FISH test.
CHANGE_ORDERS = [(120, 1, (9, 2)), (540, 1, (9,)), (960, 33, (9, 7)), (156, 25, (9, 2))]
AFTER_CHANGE = {
    "apply_change": {
        (1, "IHC", None, "Low", "none"): 1, (1, "IHC", "1", "Low", "none"): 1, (1, "IHC", None, "Negative", "none"): 1,
        (33, "IHC", None, "Negative", "conflicting"): 1, (33, "IHC", "1.0", "Low", "conflicting"): 1,
        (25, "FISH", None, "Negative", "none"): 1, (25, "FISH", "1", "Negative", "none"): 1,
    },
    "apply_change_current": {
        (1, "IHC", None, "Low1+", "none"): 1, (1, "IHC", "1", "Low1+", "none"): 1, (1, "IHC", None, "Negative", "none"): 1,
        (33, "IHC", None, "Negative", "conflicting"): 1, (33, "IHC", "1.0", "Low1+", "conflicting"): 1,
        (25, "FISH", None, "Negative", "none"): 1, (25, "FISH", "1", "Negative", "none"): 1,
    },
}


@pytest.mark.parametrize("name", AFTER_CHANGE)
def test_apply_change_lists_every_test(spark, tmp_path, name):
    """Every HER2 test with all columns, changed or not, from the query and its SQL."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    orders = ", ".join(f"({k}, {p}, TIMESTAMP '1998-05-0{i + 1}')" for i, (k, p, _) in enumerate(CHANGE_ORDERS))
    lines = ", ".join(f"({k}, 1, {s}, TIMESTAMP '1998-06-01')" for k, _, suppliers in CHANGE_ORDERS for s in suppliers)
    for table, columns, rows in (
        ("orders", "o_orderkey, o_custkey, o_orderdate", orders),
        ("lineitem", "l_orderkey, l_partkey, l_suppkey, l_shipdate", lines),
    ):
        con.execute(f"CREATE TABLE {table} AS SELECT * FROM (VALUES {rows}) AS t({columns})")
        con.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet'")
    check(spark, con, name, str(tmp_path))
    df = registry.run(name, spark, str(tmp_path))
    shown = ("patient_id", "test_method", "test_value_numeric", "test_result", "sameday_ind")
    assert Counter(map(tuple, df.select(*shown).collect())) == AFTER_CHANGE[name]
    step = "same_day_indicator" + name.removeprefix("apply_change")
    assert df.columns == registry.run(step, spark, str(tmp_path)).columns


def test_every_query_has_a_twin():
    assert set(registry.ALL) <= set(driver.queries())
    assert set(registry.ALL) <= set(driver.oracle_sql())


SORTED = {
    "o01_order_by": ("met_date", "patient_id"),
    "q_h15_conflict_rows": ("patient_id", "test_date"),
    "q_h17_labelled": ("patient_id", "test_date"),
    "q_h18_negative_tests": ("patient_id",),
    "q_h18_negative_tests_current": ("patient_id",),
    "q_h18_nearest_sorted": ("datediffer",),
}


@pytest.mark.parametrize("name", SORTED)
def test_listing_is_sorted(spark, name):
    rows = registry.run(name, spark, "/root/testdata/sf0.01").collect()
    keys = [tuple((r[c] is None, r[c] if r[c] is not None else 0) for c in SORTED[name]) for r in rows]
    assert len(rows) > 5 and keys == sorted(keys)


@pytest.mark.parametrize("report", ["receptor_report", "receptor_report_genetic", "receptor_report_current"])
def test_every_report_group_has_patients(spark, report):
    """A wrong condition can't hide behind a zero: each group is counted at sf0.01, by name."""
    row = registry.run(report, spark, "/root/testdata/sf0.01").first().asDict()
    assert set(row) == set(registry.RECEPTOR_GROUPS)
    assert [group for group, n in row.items() if n == 0] == []


def test_casts_are_up_to_date():
    assert describe.casts() == oracle._casts()


def test_entry(spark):
    df = driver.entry(spark)
    assert df.count() == 74 and "hr_status" in df.columns


def test_invariants(spark, duck):
    def rows(name):
        return {r.patient_id for r in registry.run(name, spark, SF).collect()}

    funnel = [
        "metastatic_onset", "metastatic_on_therapy", "onset_year_between", "exclude_second_primary",
        "with_test_in_window", "with_both_tests_in_window",
    ]
    sets = [rows(name) for name in funnel]
    assert all(narrow <= broad for broad, narrow in zip(sets, sets[1:]))
    assert [len(s) for s in sets] == [79, 76, *map(len, sets[2:3]), 43, len(sets[4]), len(sets[5])]
    wide = registry.run("receptor_wide", spark, SF)
    assert wide.count() == wide.select("patient_id", "met_date").distinct().count()
    pairs = registry.run("nearest_fish_for_ihc", spark, SF)
    assert pairs.agg({"n_rows": "sum"}).first()[0] == 968
    assert registry.run("her2_label", spark, SF).where("sameday_ind = 'change'").count() == 0
