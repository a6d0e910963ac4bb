"""Lempel-Ziv phrase fingerprints: the phrases a text parses into, as a minimum-hash signature."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oncolens.llm.common import pick

SLOTS = 128
EMPTY = 0xFFFF
OUT_ROWS = 1000
BASE, FIRST, SECOND = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def parse(text: str, start: int, seen: set[str], ends: list[int]) -> None:
    """LZ78 from ``start`` on: each phrase is the shortest piece not in ``seen``, which it joins.

    ``seen`` holds every prefix of what it holds, so a piece of three that is known spares
    the looks at one and two. Only the last phrase may be one already known.
    """
    i, n, add, end = start, len(text), seen.add, ends.append
    while i < n:
        j = i + 3
        if text[i:j] in seen:
            j += 1
            while j <= n and text[i:j] in seen:
                j += 1
        elif text[i : i + 2] not in seen:
            j = i + 1 if text[i : i + 1] not in seen else i + 2
        j = min(j, n)
        add(text[i:j])
        end(j)
        i = j


def phrase_hashes(text: str, start: int, ends: list[int]) -> np.ndarray:
    """64-bit hashes of the phrases that part text[start:] at ``ends``; equal phrases, equal hashes."""
    if not ends:
        return np.zeros(0, np.uint64)
    stops = np.array(ends, np.int64) - start
    starts = np.concatenate(([0], stops[:-1]))
    lengths = stops - starts
    points = np.frombuffer(text[start : ends[-1]].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    power = np.multiply.accumulate(np.full(int(lengths.max()), BASE, np.uint64))
    place = np.arange(len(points)) - np.repeat(starts, lengths)
    h = np.add.reduceat((points + np.uint64(1)) * power[place], starts) + lengths.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * FIRST
    h = (h ^ (h >> np.uint64(27))) * SECOND
    return h ^ (h >> np.uint64(31))


def least(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash in each slot; the top bits name the slot."""
    out = np.full(SLOTS, NONE)
    np.minimum.at(out, (hashes >> np.uint64(64 - 7)).astype(np.int64), hashes)
    return out


def signature(smallest: np.ndarray) -> np.ndarray:
    """16 bits of each slot's smallest hash; EMPTY where the slot has none."""
    short = ((smallest * FIRST) >> np.uint64(48)).astype(np.uint16)
    short[short == EMPTY] = 0
    short[smallest == NONE] = EMPTY
    return short


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots among those either text fills: estimates the Jaccard index of the phrase sets.

    Two empty texts are alike (1), an empty one and another are not (0).
    """
    used = (a != EMPTY) | (b != EMPTY)
    return float((a == b)[used].mean()) if used.any() else 1.0


def code(short: np.ndarray) -> str:
    return short.astype(">u2").tobytes().hex()


def fingerprint(text: str | None) -> np.ndarray:
    text, ends = text or "", []
    parse(text, 0, set(), ends)
    return signature(least(phrase_hashes(text, 0, ends)))


def edited(text: str, following: str) -> tuple[np.ndarray, str, np.ndarray]:
    """Signature of ``text``, the edited text, and its signature.

    The edit puts the beginning of ``following`` in place of the second half. Phrases
    that end in the first half are the same in both parses and are parsed once.
    """
    ends: list[int] = []
    parse(text, 0, set(), ends)
    hashes = phrase_hashes(text, 0, ends)
    half = len(text) // 2
    kept = len(text) - half
    changed = text[:kept] + following[:half]
    same = int(np.searchsorted(np.array(ends, np.int64), kept, side="right"))
    begin = ends[same - 1] if same else 0
    seen = {text[s:e] for s, e in zip([0, *ends[:same]], ends[:same], strict=False)}
    more: list[int] = []
    parse(changed, begin, seen, more)
    smallest = np.minimum(least(hashes[:same]), least(phrase_hashes(changed, begin, more)))
    return signature(least(hashes)), changed, signature(smallest)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint) per row: 128 slots of 16 bits, in hex. A null text is an empty one: all slots EMPTY."""
    columns = pick(docs, doc_id=id_column, text=text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [code(fingerprint(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.string())], ["doc_id", "fingerprint"])

    return columns.mapInArrow(run, T.StructType([columns.schema["doc_id"], T.StructField("fingerprint", T.StringType())]))


def run_heads(rows: DataFrame, n: int) -> list[tuple[bool, int, int]]:
    """The first row, as (has an id, id, print), of each of about ``n`` runs that rows in that order are cut into."""
    order = ["known", "id", "print"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [min(zip(*(c.to_pylist() for c in batch.columns), strict=True)) for batch in batches if batch.num_rows]
        if found:
            yield pa.RecordBatch.from_pylist([dict(zip(order, min(found), strict=True))], schema)

    schema = pa.schema([("known", pa.bool_()), ("id", pa.int64()), ("print", pa.int64())])
    heads = rows.select(*order).repartitionByRange(n, *order).mapInArrow(first, "known boolean, id long, print long")
    return sorted(tuple(r) for r in heads.collect())


def with_next(columns: DataFrame, run_bytes: int, most_runs: int) -> DataFrame:
    """Rows (doc_id, text) as known, id, print, text, run, guest: runs of rows that follow each other.

    Rows follow each other by id, those without one first, and by a hash of the text, so
    that a run may begin in the midst of one id's rows. The first row of a run is also
    dealt, once, to the run before as its guest; the first of all to the last. The driver
    holds one row a run, at most ``most_runs``.
    """
    rows = columns.select(
        F.col("doc_id").isNotNull().alias("known"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    heads = run_heads(rows, min(most_runs, max(1, -(-size // run_bytes))))

    @F.pandas_udf("run long, head boolean")
    def place(known: pd.Series, ids: pd.Series, prints: pd.Series) -> pd.DataFrame:
        keys = list(zip(known.tolist(), ids.tolist(), prints.tolist(), strict=True))
        runs = [max(0, bisect_right(heads, key) - 1) for key in keys]
        return pd.DataFrame({"run": runs, "head": [heads[r] == key for r, key in zip(runs, keys, strict=True)]})

    dealt = rows.withColumn("at", place("known", "id", "print"))
    own = dealt.select("known", "id", "print", "text", F.col("at.run").alias("run"), F.lit(False).alias("guest"))
    guests = dealt.where("at.head").groupBy(F.col("at.run").alias("own")).agg(F.min("text").alias("text"))
    before = F.when(F.col("own") == 0, F.lit(len(heads) - 1)).otherwise(F.col("own") - 1).cast("long")
    none = F.lit(None)
    guests = guests.select(
        none.cast("boolean").alias("known"), none.cast("long").alias("id"), none.cast("long").alias("print"),
        "text", before.alias("run"), F.lit(True).alias("guest"),
    )
    return own.unionByName(guests)


Row = tuple[bool, int, str, bool]


def in_order(rows: Iterator[Row]) -> Iterator[tuple]:
    """The answer for every row (known, id, text, guest) but the guests, from the row that follows it.

    Each text is parsed once, and equal neighbours once together.
    """
    waiting: Row | None = None  # the latest row, until the one after it is there
    done: tuple | None = None  # the one before, until the latest has its fingerprint
    pair: tuple[str, str] | None = None
    found: tuple = ()

    def answer(row: Row, own: np.ndarray, sha: str, edit: np.ndarray, next_own: np.ndarray) -> tuple:
        known, id_, text, _ = row
        return (id_ if known else None, len(text), sha, code(own), code(edit), likeness(own, edit), likeness(own, next_own))

    for row in rows:
        text, guest = row[2:]
        if waiting:
            if pair != (waiting[2], text):
                pair = (waiting[2], text)
                own, changed, edit = edited(*pair)
                found = own, hashlib.sha256(changed.encode()).hexdigest(), edit
            if done:
                yield answer(*done, found[0])
            done, waiting = (waiting, *found), None
        if not guest:
            waiting = row
        elif done:
            yield answer(*done, fingerprint(text))
            done = None


def edit_likeness(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    run_bytes: int = 8 << 20,
    most_runs: int = 10_000,
) -> DataFrame:
    """How alike each document's fingerprint is to that of an edit of it and to the next document's.

    One row per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The edited text has the beginning of the next document, by
    ascending id, in place of its second half; the last document is followed by the
    first. Null texts are empty. Rows without an id come first; rows that share an id
    follow each other in the order of a hash of their texts, equal texts one after the
    other. A single row follows itself; an empty table gives no rows. Ids are whole numbers.

    Rows are dealt into runs of about ``run_bytes``, or more where that would make over
    ``most_runs``, and each run is read once, row after row: a task holds a batch of it. So
    neither many rows of one id nor many copies of a row have to be held, and of copies in
    a row only the first is parsed.
    """
    columns = pick(docs, doc_id=id_column, text=text_column)
    schema = T.StructType(
        [
            columns.schema["doc_id"],
            *T._parse_datatype_string(
                "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
                "near_edited double, near_next double"
            ).fields,
        ]
    )
    id_type = pa.int32() if columns.schema["doc_id"].dataType.simpleString() == "int" else pa.int64()
    kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found = in_order(rows)
        while out := list(islice(found, OUT_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], schema.names)

    dealt = with_next(columns, run_bytes, most_runs).repartition("run")
    ordered = dealt.sortWithinPartitions("run", "guest", "known", "id", "print", "text")
    return ordered.select("known", "id", "text", "guest").mapInArrow(run, schema)
