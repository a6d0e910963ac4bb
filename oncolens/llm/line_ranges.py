"""Line dedup: range-partitioned line hashes, first occurrences streamed, keep bitmaps per document.

Every distinct long line of a document becomes one narrow row: 128-bit hash, document,
positions. Rows are range-partitioned and sorted by hash, document and text, so the first
row of a hash names the document that keeps it and a task only has to remember one hash.
The ranges cut through hashes: a line that a third of all documents hold lies in many
tasks. What a task cannot know is whether the hash it begins with began before, so it
passes those rows on with its own first document, and beside them the last hash it saw;
one row a task settles them.

Text never moves with the hashes. What comes back is a compressed bitmap of kept lines
for each document that loses some.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oncolens.llm.common import pick, store
from oncolens.operators.grouping import join_groups

NO_ID = np.iinfo(np.int64).max
MOST_UTF8 = 4  # bytes of a code point
LINE_ROWS = "hi long, lo long, doc long, print long, n_lines long, places binary"
SEEN = "lead boolean, last boolean, hi long, lo long, first long, doc long, print long, n_lines long, places binary"


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased; ``bytes`` methods touch ASCII alone."""
    return line.strip().lower()


def is_long(key: bytes, shortest: int) -> bool:
    return len(key) >= shortest and (len(key) >= MOST_UTF8 * shortest or len(key.decode()) >= shortest)


def long_lines(text: bytes, shortest: int) -> tuple[int, dict[bytes, list[int]]]:
    """How many lines, and where each distinct long line is, by its 128-bit hash."""
    lines = text.split(b"\n")
    places: dict[bytes, list[int]] = {}
    for k, line in enumerate(lines):
        key = line_key(line)
        if is_long(key, shortest):
            places.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(k)
    return len(lines), places


def line_rows(docs: DataFrame, shortest: int) -> DataFrame:
    """LINE_ROWS of ``docs`` (doc, text, print). Rows equal in all three are merged batch by batch: their fate is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, seal, digests, of, n_lines, where = [], [], [], [], [], []
            distinct = dict.fromkeys(zip(*(batch.column(c).to_pylist() for c in ("doc", "print", "text")), strict=True))
            for d, p, text in distinct:
                n, places = long_lines((text or "").encode(), shortest)
                of.append(len(places))
                doc.append(d)
                seal.append(p)
                n_lines.append(n)
                digests += places
                where += [np.array(at, "<u4").tobytes() for at in places.values()]
            if not digests:
                continue
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1])]
            columns += [pa.array(np.repeat(np.array(c, np.int64), of)) for c in (doc, seal, n_lines)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(where, pa.binary())], names)

    names = T._parse_datatype_string(LINE_ROWS).names
    return docs.mapInArrow(run, LINE_ROWS)


def first_seen(rows: DataFrame) -> DataFrame:
    """SEEN, from rows in order of hash and document, each task by itself.

    Rows of a task's first hash come out with ``lead`` and the first document known here.
    Of the other hashes only the rows that another document holds earlier come out. One
    more row, ``last``, names the task's last hash and its first document.
    """
    schema = T._parse_datatype_string(SEEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = current = None  # the first hash, and the latest with its first document
        first = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            hi, lo, doc = (batch.column(c).to_numpy() for c in ("hi", "lo", "doc"))
            begin = begin or (hi[0], lo[0])
            new = np.concatenate(([(hi[0], lo[0]) != current], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
            heads = np.flatnonzero(new)
            firsts = np.concatenate(([first], doc[heads]))[np.cumsum(new)]
            lead = (hi == begin[0]) & (lo == begin[1])
            out = np.flatnonzero(lead | (doc != firsts))
            current, first = (hi[-1], lo[-1]), firsts[-1]
            if len(out):
                columns = [pa.array(lead[out]), pa.array(np.zeros(len(out), bool)), pa.array(hi[out]), pa.array(lo[out])]
                columns += [pa.array(firsts[out]), *[batch.column(c).take(pa.array(out)) for c in schema.names[5:]]]
                yield pa.RecordBatch.from_arrays(columns, schema.names)
        if current:
            values = [False, True, *current, first, None, None, None, None]
            kinds = [pa.bool_(), pa.bool_(), *[pa.int64()] * 6, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], schema.names)

    return rows.mapInArrow(run, schema)


def dropped_rows(seen: DataFrame) -> DataFrame:
    """(doc, print, n_lines, places) of lines that an earlier document holds; ``seen`` is read three times and stored."""
    borders = seen.where("last").groupBy("hi", "lo").agg(F.min("first").alias("before"))
    wanted = ("doc", "print", "n_lines", "places")
    plain = seen.where("NOT last AND NOT lead").select(*wanted)
    # Borders have 24 bytes for each task of the sort at most, whatever the input; rows of one hash stay spread.
    lead = seen.where("lead").join(F.broadcast(borders), ["hi", "lo"], "left")
    late = lead.where(F.col("doc") > F.least("first", "before")).select(*wanted)
    return plain.unionByName(late)


def bitmap(n_lines: int, dropped: np.ndarray) -> bytes:
    """One bit a line, 1 for kept, first line in the highest bit; compressed."""
    keep = np.ones(n_lines, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def kept_lines(packed: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n_lines).astype(bool)


def _identified(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    picked = pick(docs, doc_id=id_column, text=text_column)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID)))
    return picked.select("doc_id", doc.alias("doc"), F.xxhash64("text").alias("print"), "text")


def keep_bitmaps(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shortest: int = 10) -> DataFrame:
    """(doc, print, n_lines, n_dropped, keep): which lines stay, for every document that loses some.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys
    of at least ``shortest`` code points that two documents hold lose all their lines but
    those of the document with the smallest id. ``keep`` has a bit a line (``kept_lines``
    reads it). ``doc`` is the id, for a null id the largest whole number, and ``print`` a
    hash of the text; together they name a row of ``docs``, equal rows once.

    Ids are whole numbers; a null id counts as larger than all. Rows that repeat an id are
    one document to this rule. A null or empty text is one empty line. An empty table
    gives no rows. Lines are compared by 128-bit hashes.
    """
    rows = line_rows(_identified(docs, id_column, text_column).select("doc", "text", "print"), shortest)
    order = ["hi", "lo", "doc", "print"]
    seen = store(first_seen(rows.repartitionByRange(*order).sortWithinPartitions(*order)), "lines")
    # Copies of a document bring equal places; a set that is combined map-side holds them once.
    places = dropped_rows(seen).groupBy("doc", "print").agg(
        F.max("n_lines").alias("n_lines"), F.collect_set("places").alias("places")
    )
    schema = "doc long, print long, n_lines long, n_dropped long, keep binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_dropped, keep = [], []
            for n, found in zip(batch.column("n_lines").to_pylist(), batch.column("places").to_pylist(), strict=True):
                at = np.frombuffer(b"".join(found), "<u4")
                n_dropped.append(len(at))
                keep.append(bitmap(n, at))
            columns = [batch.column(c) for c in ("doc", "print", "n_lines")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_dropped, pa.int64()), pa.array(keep, pa.binary())],
                ["doc", "print", "n_lines", "n_dropped", "keep"],
            )

    return places.mapInArrow(run, schema)


def kept_text(text: str | None, packed: bytes | None) -> tuple[int, int, str]:
    """Number of lines, of dropped lines, and the kept ones joined by line feeds."""
    lines = (text or "").split("\n")
    if packed is None:
        return len(lines), 0, text or ""
    keep = kept_lines(packed, len(lines))
    kept = [line for line, k in zip(lines, keep.tolist(), strict=True) if k]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def drop_repeated_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shortest: int = 10
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_text, by the rule of ``keep_bitmaps``.

    Bitmaps meet the texts in a left join that adaptive execution can split where one id
    and text repeats often. A null text comes back as an empty one.
    """
    given = _identified(docs, id_column, text_column)
    bitmaps = keep_bitmaps(docs, id_column, text_column, shortest).select("doc", "print", "keep")
    joined = join_groups(given, bitmaps, ["doc", "print"], "left").select("doc_id", "text", "keep")
    schema = T.StructType(
        [joined.schema["doc_id"], *T._parse_datatype_string("n_lines long, n_dropped long, kept_text string").fields]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [kept_text(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("text", "keep")), strict=True)]
            counts = [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)]
            kept = pa.array([f[2] for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, kept], schema.names)

    return joined.mapInArrow(run, schema)
