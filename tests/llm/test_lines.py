"""Line dedup against a plain statement of its rule."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from oncolens.llm import line_ranges
from tests.llm.conftest import ODD

BLANK = " \t\n\v\f\r"


def plain(rows, shortest=10):
    """(id, n_lines, n_dropped, kept) per (id, text), by the rule as written."""

    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(BLANK))

    number = lambda i: float("inf") if i is None else i
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= shortest:
                first[key(line)] = min(first.get(key(line), float("inf")), number(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if len(key(line)) < shortest or first[key(line)] == number(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=lambda r: (number(r[0]), *r[1:]))


def found(docs, **options):
    rows = [tuple(r) for r in line_ranges.drop_repeated_lines(docs, **options).collect()]
    return sorted(rows, key=lambda r: (float("inf") if r[0] is None else r[0], *r[1:]))


def check(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", b"") for i, t in rows], "doc_id long, text string, doc string, places binary")
    assert found(docs.repartition(5), **options) == plain(rows, **options)


def test_rule(spark):
    lines = [f"line number {k}" for k in range(12)] + ["short", "SHORT", "  Line Number 3\r", "LINE NUMBER 4\t", "", " ", "é" * 9, "É" * 10, "é" * 10]
    pick = random.Random(5)
    rows = [(pick.randrange(40), "\n".join(pick.choice(lines) for _ in range(pick.randrange(12)))) for _ in range(60)]
    rows += [(1000 + k, t) for k, t in enumerate(ODD)] + [(k, t) for k, t in enumerate(ODD)]
    rows += [(None, "line number 1\nown line of nobody"), (None, "own line of nobody"), (-5, "line number 2\n\n")] * 3
    check(spark, rows)
    check(spark, rows, shortest=1)


def test_spaces_that_are_not_ascii_and_case_beyond_a_to_z(spark):
    check(spark, [(0, " ten letters\nİstanbul 12345"), (1, "ten letters\ni̇stanbul 12345"), (2, "\x1cten letters")])


def test_one_line_in_all_documents_lies_in_many_tasks(spark):
    """The common line's rows cross task borders; the smallest id is in none but the first of them."""
    rows = [(k, f"a line that all documents hold\nonly in document {k}") for k in range(3, 3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
        narrow = line_ranges.line_rows(line_ranges._identified(docs, "doc_id", "text").select("doc", "text", "print"), 10)
        order = ["hi", "lo", "doc", "print"]
        seen = line_ranges.first_seen(narrow.repartitionByRange(8, *order).sortWithinPartitions(*order))
        common = seen.where("lead").groupBy("hi").count().agg(F.max("count")).first()[0]
        assert common > 500  # rows handed on by the tasks that begin inside the common line
        assert found(docs) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_copies_of_a_row_are_merged_before_the_shuffle(spark):
    docs = spark.createDataFrame([(None, "a line of some length\nand another one")] * 4000, "doc_id long, text string")
    narrow = line_ranges.line_rows(line_ranges._identified(docs.coalesce(1), "doc_id", "text").select("doc", "text", "print"), 10)
    assert narrow.count() <= 4
    assert {r[1:] for r in found(docs)} == {(2, 0, "a line of some length\nand another one")}


def test_empty_table_and_bitmaps(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []
    docs = spark.createDataFrame([(1, "x" * 12), (2, "kept\n" + "x" * 12), (2, "kept\n" + "x" * 12)], "doc_id int, text string")
    (row,) = line_ranges.keep_bitmaps(docs).collect()
    assert (row.doc, row.n_lines, row.n_dropped) == (2, 2, 1)
    assert line_ranges.kept_lines(row.keep, 2).tolist() == [True, False]


@pytest.mark.parametrize("n", [1, 7, 8, 9, 100_000])
def test_bitmap_round_trip(n):
    import numpy as np

    gone = np.arange(0, n, 3)
    keep = line_ranges.kept_lines(line_ranges.bitmap(n, gone), n)
    assert len(keep) == n and np.flatnonzero(~keep).tolist() == gone.tolist()
