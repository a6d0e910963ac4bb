"""Best-fit-decreasing packing of token sequences, exact over the whole corpus.

Documents of one length are interchangeable, so the packing needs only the histogram of
lengths, which has at most ``capacity`` entries whatever the corpus. It is planned from
that histogram with a segment tree over remaining capacities; Spark numbers the
documents of each length and looks their places up in the plan.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oncolens.llm.common import cell, numbered, pick, store

# The byte-level tokenizer's cut of a text into pieces, which no token crosses.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """Ids of texts under a byte-level tokenizer file, its special tokens' strings being ordinary text.

    The file is written for the tokenizers library. Its vocabulary lists tokens in the
    order of their merges, so tiktoken gives the same ids from it at a third of the cost;
    the tests hold the two against each other.
    """

    made: dict[str, Encoder] = {}
    #: The pattern of PIECES looks ahead behind white space, for which tiktoken needs a stack as deep as the run is long.
    SAFE_RUN = 10_000

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        special = {t["content"] for t in parts["added_tokens"]}
        byte = {letter: b for b, letter in byte_letters().items()}
        ranks = {bytes(byte[c] for c in t): i for t, i in parts["model"]["vocab"].items() if t not in special}
        self.coder = tiktoken.Encoding("pieces", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.ranks = ranks
        self.path = path
        self.long_run = re.compile(rf"\s{{{self.SAFE_RUN}}}")

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    @cached_property
    def careful(self):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.encode_special_tokens = True
        return made

    def ids(self, text: str) -> list[int]:
        if len(text) >= self.SAFE_RUN and self.long_run.search(text):
            return self.careful.encode(text, add_special_tokens=False).ids
        return self.coder.encode_ordinary(text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        return np.array(self.ids(text), "<u4").tobytes()

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id; ids that stand for none have no bytes."""
        out = [b""] * (max(self.ranks.values()) + 1)
        for token, k in self.ranks.items():
            out[k] = token
        return out


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: all full but the first, which takes what is left over."""
    first = (n - 1) % capacity + 1
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def pieces(docs: DataFrame, path: str | None, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt[, ids]) from the whole text and the end token of every row.

    ``ids`` have 16 bits each where all ids fit, else 32; the checksum is that of 32. ``salt``
    tells equal pieces apart: it counts a task's pieces.
    """
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            *T._parse_datatype_string("piece int, start long, length long, ids_crc32 long, salt long").fields,
            *([T.StructField("ids", T.BinaryType())] if with_ids else []),
        ]
    )
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = Encoder.of(path or public_tokenizers.path("byte_bpe_50k.json"))
        dtype = "<u2" if max(*encoder.ranks.values(), end_id) < 1 << 16 else "<u4"
        salt = 0
        for batch in batches:
            row, out = [], []
            for r, text in enumerate(batch.column(1)):
                ids = np.array([*encoder.ids(text.as_py() or ""), end_id], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    row.append(r)
                    out.append((k, start, length, zlib.crc32(own.tobytes()), salt, own.astype(dtype).tobytes() if with_ids else None))
                    salt += 1
            columns = [batch.column(0).take(pa.array(row, pa.int64()))]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns += [pa.array([o[i] for o in out], kinds[i]) for i in range(len(names) - 1)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)


class SegmentTree:
    """Which remaining capacities have an open bin; finds the tightest that fits in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        k = capacity + self.leaves
        self.open[k] = is_open
        while k > 1:
            k //= 2
            self.open[k] = self.open[2 * k] or self.open[2 * k + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest open capacity that is at least ``length``."""
        k = length + self.leaves
        if self.open[k]:
            return length
        while k > 1:
            if k % 2 == 0 and self.open[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.open[2 * k] else 2 * k + 1
                return k - self.leaves
            k //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, decreasing, for whole runs of equal lengths: (length, first rank, first bin, per bin, offset).

    Items of ``length`` from that rank on fill bins from that bin on, so many to a bin,
    the first at that offset. While no bin between ``length`` and a capacity r is open,
    best fit puts item after item into the same bin of r, so runs give what single items would.
    """
    tree, open_bins, out, bins = SegmentTree(capacity), defaultdict(list), [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            open_bins[room].append((first, n))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            room = tree.tightest(length)
            if room is None:
                n = -(-(count - rank) // (capacity // length))
                put(capacity, bins, n)
                bins += n
                continue
            first, n = open_bins[room].pop()
            if not open_bins[room]:
                tree.set(room, False)
            each = room // length
            full = min(n, (count - rank) // each)
            if full:
                out.append((length, rank, first, each, capacity - room))
                rank += full * each
                put(room - each * length, first, full)
            if full < n:
                rest = count - rank
                if rest:
                    out.append((length, rank, first + full, rest, capacity - room))
                    rank = count
                    put(room - rest * length, first + full, 1)
                    full += 1
                put(room, first + full, n - full)
    return out


def place(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of the item of each length and rank; ``table`` is a plan sorted by length and rank."""
    key = (table[:, 0] << 44) + table[:, 1]
    row = table[np.searchsorted(key, (length << 44) + rank, side="right") - 1]
    beyond = rank - row[:, 1]
    return row[:, 2] + beyond // row[:, 3], row[:, 4] + beyond % row[:, 3] * length


def widened(ids: pa.BinaryArray, length: np.ndarray) -> pa.BinaryArray:
    """Ids of 32 bits, from such or from those of 16 bits."""
    return pa.array(
        [v if len(v) == 4 * n else np.frombuffer(v, "<u2").astype("<u4").tobytes() for v, n in zip(ids.to_pylist(), length.tolist(), strict=True)],
        pa.binary(),
    )


def pack(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer: str | None = None,
    capacity: int = 1024,
    end_id: int = 2,
    with_ids: bool = False,
    cells: int = 256,
    cell_rows: int = 1 << 18,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. Only
    longer documents are cut. Rows that repeat an id, whole rows too, are documents of
    their own; null ids stay null. Sequence ids count from 0 without gaps. An empty table
    gives no rows. ``tokenizer`` is the path of a byte-level tokenizer file.

    The driver sees the histogram of lengths only (``capacity`` rows); the plan it sends
    back grows with ``capacity``, not with the corpus. ``ids`` are little-endian 32-bit; between
    stages they have 16 bits where the vocabulary allows it.
    Pieces of one length are numbered in ``cells`` cells, more if a cell of the commonest
    length would have over ``cell_rows`` rows.
    """
    found = store(pieces(pick(docs, doc_id=id_column, text=text_column), tokenizer, capacity, end_id, with_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    table = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 5)
    cells = max(cells, -(-max(histogram.values(), default=0) // cell_rows))
    dealt = found.withColumn("cell", cell(cells, F.col("doc_id"), F.col("piece"), F.col("ids_crc32"), F.col("salt")))
    ranked = numbered(dealt.drop("salt"), ["length"], ["cell"], ["doc_id", "piece", "ids_crc32", "start"], "rank")
    names = [c for c in found.columns if c != "salt"]
    schema = T.StructType(
        [*[ranked.schema[c] for c in names], *T._parse_datatype_string("sequence_id long, offset long").fields]
    )
    ranked = ranked.select(*names, "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
                bins, offset = place(table, length, rank)
                columns = [widened(batch.column(c), length) if c == "ids" else batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bins), pa.array(offset)], schema.names)

    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from rows packed with their ids: each sequence's bytes in order of offset."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` tokens
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
