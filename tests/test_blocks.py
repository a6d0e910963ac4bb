"""Shared building blocks against brute force."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from oncolens.operators.grouping import (
    count_patients,
    dense_rank_values,
    agreeing_groups,
    drop_conflicting_groups,
    group_stats,
    keys_in,
    keys_not_in,
    left_join_many,
    merge_copies,
    repeat_rows,
)
from oncolens.operators.nearest import nearest_days


def test_group_stats_match_a_window_with_null_keys(frame):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), rng.choice(["a", None]), rng.choice(["x", "y", "z", None])) for _ in range(60)]
    df = frame("k bigint, g string, v string", *rows)
    groups = {}
    for k, g, v in rows:
        groups.setdefault((k, g), []).append(v)
    want = Counter()
    for k, g, v in rows:
        values = [x for x in groups[(k, g)] if x is not None]
        want[(k, g, v, min(values, default=None), max(values, default=None))] += 1
    got = group_stats(df, ["k", "g"], lo=F.min("v"), hi=F.max("v")).select("k", "g", "v", "lo", "hi").collect()
    assert Counter(tuple(r) for r in got) == want
    kept = Counter()
    for (k, g, v, lo, hi), n in want.items():
        if lo == hi:
            kept[(k, g, v)] += n
    got = drop_conflicting_groups(df, ["k", "g"], "v").select("k", "g", "v").collect()
    assert Counter(tuple(r) for r in got) == kept
    got = agreeing_groups(df, ["k", "g"], "v", named=F.count("v"), n=F.count("*")).collect()
    spread = Counter()
    for k, g, v, named, n in map(tuple, got):
        spread += Counter({(k, g, v): named, (k, g, None): n - named})
    assert spread == kept


def test_dense_rank_of_distinct_values(frame):
    df = frame("k bigint, v string", (1, "b"), (1, "b"), (1, "a"), (1, None), (2, None))
    got = {tuple(r) for r in dense_rank_values(df, ["k"], "v", "r").collect()}
    assert got == {(1, "a", 1), (1, "b", 2), (1, None, 3), (2, None, 1)}


@pytest.mark.parametrize("cells", [1, 2, 7, 500])
def test_dense_rank_in_ranges(frame, cells):
    """However many ranges a group is cut into, null keys and null values among it."""
    rng = random.Random(cells)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice(["", "a", "ab", "b", "é", "Z", None, *map(str, range(30))])) for _ in range(300)]
    want = set()
    for key in {k for k, _ in rows}:
        values = {v for k, v in rows if k == key}
        ordered = [*sorted((v for v in values if v is not None), key=str.encode), *[None] * (None in values)]
        want |= {(key, v, place) for place, v in enumerate(ordered, 1)}
    df = frame("k bigint, v string", *rows)
    assert {tuple(r) for r in dense_rank_values(df, ["k"], "v", "r", cells).collect()} == want


def test_in_and_not_in(frame):
    rows = frame("patient_id bigint, v bigint", (1, 1), (1, 2), (2, 3), (None, 4))
    listed = frame("patient_id bigint", (1,), (1,))
    with_null = frame("patient_id bigint", (1,), (None,))
    empty = listed.where(F.lit(False))

    def values(df):
        return sorted(r.v for r in df.collect())

    assert values(keys_in(rows, listed)) == [1, 2]
    assert values(keys_not_in(rows, listed)) == [3, 4]
    # SQL's NOT IN: a null key fails against a non-empty list, a null in the list fails all.
    assert values(keys_not_in(rows, listed, null_aware=True)) == [3]
    assert values(keys_not_in(rows, with_null, null_aware=True)) == []
    assert values(keys_not_in(rows, empty, null_aware=True)) == [1, 2, 3, 4]


def test_count_patients(frame):
    df = frame("patient_id bigint, v string", (1, "a"), (1, "b"), (2, "b"), (None, "a"), (3, None))
    row = count_patients(df, a=F.col("v") == "a", b=F.col("v") == "b", any=F.lit(True)).first()
    assert (row.a, row.b, row.any) == (1, 2, 3)


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 2051])
def test_repeat_rows(frame, n):
    out = repeat_rows(frame("k bigint, n_rows bigint", (1, n), (2, 1)))
    assert out.columns == ["k"]
    assert dict(out.groupBy("k").count().collect()) == {1: n, 2: 1}


def test_merge_copies_adds_up_counts(frame):
    once = merge_copies(frame("k bigint, v string", (1, "a"), (1, "a"), (1, None)), "k", "v")
    assert {tuple(r) for r in once.collect()} == {(1, "a", 2), (1, None, 1)}
    assert merge_copies(once, "k").collect()[0].n_rows == 3


def test_nearest_days_against_all_pairs(frame):
    rng = random.Random(11)
    start = dt.date(2000, 1, 1)

    def day():
        return str(start + dt.timedelta(days=rng.randrange(40)))

    left = sorted({(p, day()) for p in range(12) for _ in range(6)})
    right = [(p, day() if rng.random() < 0.8 else None) for p in range(10) for _ in range(rng.randrange(7))]
    want = set()
    for p, d in left:
        here = dt.date.fromisoformat(d)
        others = {dt.date.fromisoformat(x) for q, x in right if q == p and x}
        best = min((abs((o - here).days) for o in others), default=None)
        want |= {(p, d, str(o)) for o in others if abs((o - here).days) == best} or {(p, d, None)}
    got = nearest_days(
        frame("patient_id bigint, a date", *left), "a", frame("patient_id bigint, b date", *right), "b", "near"
    ).collect()
    assert len(got) == len(want)
    assert {(r.patient_id, str(r.a), r.near and str(r.near)) for r in got} == want


def test_left_join_many(frame):
    cohort = frame("patient_id bigint, met_date date", (1, "2000-01-01"), (2, "2000-01-02"))
    rows = frame("patient_id bigint, v string", (1, "a"), (1, "b"), (3, "c"), (None, "d"))
    got = {(r.patient_id, str(r.met_date), r.v) for r in left_join_many(cohort, rows).collect()}
    assert got == {(1, "2000-01-01", "a"), (1, "2000-01-01", "b"), (2, "2000-01-02", None)}
