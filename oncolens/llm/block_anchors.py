"""Substring dedup with fixed-block anchors.

Each document is cut into blocks of 7 words that do not overlap: the reference index.
Every rolling run of 7 words, of every document, probes it. Any 13 consecutive words
hold a whole block of their document, so a repeat of 13 words is always anchored. Round
the hits the windows of 13 words are compared exactly, which extends each hit to its
maximal repeat: the union of the windows that also start in an earlier document.

Nothing is paired. Texts are dealt into chunks of a few megabytes; a chunk sends its
distinct hashes, sorted and packed into bytes, to the part of the hash space they fall
in, and a part answers each chunk which of them count. A passage in a million documents
costs a few bytes per chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oncolens.llm.common import Numbers, pick

WORD, SIDE = (np.uint64(v) for v in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))
NO_ID = np.iinfo(np.int64).max  # a null id: larger than every other, and never smaller than another null
KEY_BYTES = 6
ROW_BYTES = 16  # of a row beside its text, so that empty texts are spread too


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 of the result."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(words: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places have none.

    Every word is mixed in before the next, so that no sum of word hashes can be traded
    for another of the same value.
    """
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.full(len(words) - n + 1, base, np.uint64)
    for k in range(n):
        total ^= words[k : k + len(total)]
        total *= base
        total ^= total >> np.uint64(32)
    return mix(total)


class Chunk:
    """The words of a chunk's texts, in the order of the rows, as two independent 64-bit hashes of their bytes."""

    def __init__(self, ids: pa.ChunkedArray, texts: pa.ChunkedArray):
        self.ids = np.array([NO_ID if i is None else i for i in ids.to_pylist()], np.int64)
        self.raw = [(t or "").encode() for t in texts.to_pylist()]
        number = Numbers()
        codes = [np.zeros(0, np.int32)]
        for text in self.raw:
            words = text.split()  # bytes: ASCII white space alone
            codes.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        self.counts = np.array([len(c) for c in codes[1:]], np.int64)
        digests = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in number)
        hashes = np.frombuffer(digests, "<u8").reshape(-1, 2)
        code = np.concatenate(codes)
        self.words, self.sides = hashes[code, 0], hashes[code, 1]
        self.doc = np.repeat(np.arange(len(self.raw), dtype=np.int32), self.counts)
        self.first = np.cumsum(self.counts) - self.counts
        self.place = np.arange(len(self.words)) - np.repeat(self.first, self.counts)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of n words inside one document, and their hashes."""
        h = rolling(self.words, n, WORD)
        own = np.flatnonzero(self.doc[: len(h)] == self.doc[n - 1 :]) if len(h) else np.zeros(0, np.int64)
        return own, h[own]

    def side_hashes(self, starts: np.ndarray, n: int) -> np.ndarray:
        """32 more bits of the windows of n words at ``starts``, from the words' second hashes."""
        total = np.full(len(starts), SIDE, np.uint64)
        for k in range(n):
            total ^= self.sides[starts + k]
            total *= SIDE
            total ^= total >> np.uint64(32)
        return mix(total) >> np.uint64(32)


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of sorted numbers, highest bytes first and together, so that they compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, width - 1 :: -1].T).tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes[::-1].T
    return out.view("<u8").ravel()


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1))


def rows_by_part(n_parts: int, chunk: int, key: np.ndarray, encode: Callable[[slice], dict[str, bytes]]) -> list[dict]:
    """A row for each part of the hash space that some of the sorted 64-bit keys fall in."""
    part = ((key >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)
    begin = runs(part)
    stop = np.append(begin[1:], len(key))
    return [
        {"part": p, "chunk": chunk, **encode(slice(a, b))}
        for p, a, b in zip(part[begin].tolist(), begin.tolist(), stop.tolist(), strict=True)
    ]


def anchor_rows(chunk: Chunk, number: int, block: int, n_parts: int) -> list[dict]:
    """The chunk's distinct probes: hash prefix, whether two documents have it, whether it is a reference block."""
    at, h = chunk.windows(block)
    key = h >> np.uint64(64 - 8 * KEY_BYTES)
    order = np.argsort(key, kind="stable")  # by document within a key
    key, doc, anchor = key[order], chunk.doc[at][order], (chunk.place[at] % block == 0)[order]
    begin = runs(key)
    if not len(begin):
        return []
    last = np.concatenate((begin[1:], [len(key)])) - 1
    flags = (doc[begin] != doc[last]) + 2 * np.logical_or.reduceat(anchor, begin).astype(np.uint8)
    key = key[begin]
    return rows_by_part(
        n_parts,
        number,
        key << np.uint64(64 - 8 * KEY_BYTES),
        lambda s: {"keys": pack(key[s], KEY_BYTES), "flags": flags[s].astype(np.uint8).tobytes()},
    )


def answer_anchors(packs: pa.Table) -> pa.Table:
    """For each chunk its keys that two documents share and one has as a reference block."""
    chunks = packs.column("chunk").to_numpy()
    keys = [unpack(b, KEY_BYTES) for b in packs.column("keys").to_pylist()]
    flags = np.concatenate([np.frombuffer(b, np.uint8) for b in packs.column("flags").to_pylist()])
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    begin = runs(key[order])
    count = np.diff(np.concatenate((begin, [len(key)])))
    any_flag = np.bitwise_or.reduceat(flags[order], begin)
    good = ((count > 1) | (any_flag & 1 > 0)) & (any_flag & 2 > 0)
    picked = np.zeros(len(key), bool)
    picked[order] = np.repeat(good, count)
    bounds = np.cumsum([0, *map(len, keys)])
    found = [(c, k[picked[bounds[i] : bounds[i + 1]]]) for i, (c, k) in enumerate(zip(chunks, keys, strict=True))]
    found = [(c, pack(k, KEY_BYTES)) for c, k in found if len(k)]
    return pa.table({"chunk": pa.array([c for c, _ in found], pa.int64()), "keys": pa.array([k for _, k in found], pa.binary())})


def window_rows(chunk: Chunk, number: int, shared: np.ndarray, block: int, window: int, n_parts: int) -> list[dict]:
    """Windows round the chunk's anchor hits: a 96-bit hash, the smallest id that has it here, whether several have."""
    at, h = chunk.windows(block)
    hit = np.zeros(len(chunk.words) + window, np.int64)
    if len(shared):
        key = h >> np.uint64(64 - 8 * KEY_BYTES)
        spot = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
        hit[at[shared[spot] == key]] = 1
    total = np.concatenate(([0], np.cumsum(hit)))
    start, key = chunk.windows(window)
    near = total[start + window - block + 1] - total[start] > 0
    start, key = start[near], key[near]
    side = chunk.side_hashes(start, window)
    order = np.lexsort((side, key))
    key, side, ids = key[order], side[order], chunk.ids[chunk.doc[start][order]]
    begin = runs(key, side)
    if not len(begin):
        return []
    low, high = np.minimum.reduceat(ids, begin), np.maximum.reduceat(ids, begin)
    key, side, several = key[begin], side[begin], (low != high).astype(np.uint8)
    return rows_by_part(
        n_parts,
        number,
        key,
        lambda s: {
            "keys": pack(key[s], 8),
            "sides": pack(side[s], 4),
            "lows": pack(low[s].view(np.uint64), 8),
            "several": several[s].tobytes(),
        },
    )


def answer_windows(packs: pa.Table) -> pa.Table:
    """For each chunk the windows, by all 96 bits, that an earlier document elsewhere has (2), or only one here (1)."""
    chunks = packs.column("chunk").to_numpy()
    keys = [unpack(b, 8) for b in packs.column("keys").to_pylist()]
    sides = [unpack(b, 4) for b in packs.column("sides").to_pylist()]
    side, low = np.concatenate(sides), np.concatenate([unpack(b, 8) for b in packs.column("lows").to_pylist()])
    several = np.concatenate([np.frombuffer(b, np.uint8) for b in packs.column("several").to_pylist()])
    key, low = np.concatenate(keys), low.view(np.int64)
    order = np.lexsort((side, key))
    begin = runs(key[order], side[order])
    least = np.empty(len(key), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(low[order], begin), np.diff(np.concatenate((begin, [len(key)]))))
    says = np.where(least < low, 2, several).astype(np.uint8)
    bounds = np.cumsum([0, *map(len, keys)])
    out: dict[str, list] = {"chunk": [], "keys": [], "sides": [], "says": []}
    for i, c in enumerate(chunks):
        says_here = says[bounds[i] : bounds[i + 1]]
        if (told := says_here > 0).any():
            out["chunk"].append(c)
            out["keys"].append(pack(keys[i][told], 8))
            out["sides"].append(pack(sides[i][told], 4))
            out["says"].append(says_here[told].tobytes())
    return pa.table({c: pa.array(v, pa.int64() if c == "chunk" else pa.binary()) for c, v in out.items()})


def covered_words(chunk: Chunk, told: np.ndarray, sides: np.ndarray, says: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window that also starts in a document with a smaller id.

    ``told`` is sorted. Windows whose 64 bits are equal and whose 32 others are not are apart.
    """
    cover = np.zeros(len(chunk.words) + 1, np.int64)
    if len(told):
        start, key = chunk.windows(window)
        first = np.searchsorted(told, key)
        hit = told[np.minimum(first, len(told) - 1)] == key
        start, key, first = start[hit], key[hit], first[hit]
        side = chunk.side_hashes(start, window)
        spot = np.full(len(start), -1)
        most = np.diff(np.append(runs(told), len(told))).max()
        for k in range(most):  # once, but for hashes of which half is equal
            at = np.minimum(first + k, len(told) - 1)
            same = (told[at] == key) & (sides[at] == side)
            spot[same] = at[same]
        start, spot = start[spot >= 0], spot[spot >= 0]
        ids = chunk.ids[chunk.doc[start]]
        least = np.full(len(told), NO_ID)
        np.minimum.at(least, spot, ids)
        bad = start[(says[spot] == 2) | (ids > least[spot])]
        np.add.at(cover, bad, 1)
        np.add.at(cover, bad + window, -1)
    return np.cumsum(cover)[:-1] > 0


def results(chunk: Chunk, gone: np.ndarray) -> Iterator[tuple[int, int, list[int], list[int], str]]:
    """Per document: words, words removed, starts and lengths of the removed runs, kept text."""
    for text, first, n in zip(chunk.raw, chunk.first.tolist(), chunk.counts.tolist(), strict=True):
        out = gone[first : first + n]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], out.astype(np.int8), [0]))))
        words = text.split()
        if len(edges):
            words = [w for w, g in zip(words, out.tolist(), strict=True) if not g]
        yield n, int(out.sum()), edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist(), b" ".join(words).decode()


def remove_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: tuple[str, ...] = (),
    window: int = 13,
    chunk_bytes: int = 8 << 20,
    part_bytes: int = 20 << 20,
    untouched: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns ``keep``, n_words, n_removed, removed spans, kept_text.

    Words are runs of anything but ASCII white space. A word is removed if some window of
    ``window`` words that covers it also starts in a document with a smaller id. Ids are
    whole numbers; a null id counts as larger than all. Rows that repeat an id are one
    document to this rule and keep what only they share. A null text is empty; kept words
    are joined by one space, but with ``untouched`` a text that loses nothing comes back as
    it was, a null as null; an empty table gives no rows. ``keep`` must not hold
    ``id_column`` or ``text_column``.

    ``chunk_bytes`` and ``part_bytes`` bound a task's share of text and of hash space.
    A chunk must hold its longest text. Rows without an id are dealt over chunks by a row
    number too, which must be the same whenever they are read, as it is from files; of rows
    with one, those equal in id and text share a chunk, which ids that are keys rule out.
    Windows are compared by 96 bits, made of two hashes of each word's bytes.
    """
    block = (window + 1) // 2
    columns = pick(docs, doc_id=id_column, text=text_column, **{f"keep{i}": c for i, c in enumerate(keep)})
    size = columns.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    n_chunks, n_parts = max(1, -(-size // chunk_bytes)), max(1, -(-size // part_bytes))
    salt = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    dealt = columns.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", salt), F.lit(n_chunks)))
    columns_out = [f"keep{i}" for i in range(len(keep))]

    def table(rows: list[dict], schema: pa.Schema) -> pa.Table:
        return pa.Table.from_pylist(rows, schema)

    longs, blobs = pa.int64(), pa.binary()
    anchor_schema = pa.schema([("part", longs), ("chunk", longs), ("keys", blobs), ("flags", blobs)])
    window_schema = pa.schema(
        [("part", longs), ("chunk", longs), ("keys", blobs), ("sides", blobs), ("lows", blobs), ("several", blobs)]
    )

    def send_anchors(key: tuple, rows: pa.Table) -> pa.Table:
        chunk = Chunk(rows.column("doc_id"), rows.column("text"))
        return table(anchor_rows(chunk, key[0].as_py(), block, n_parts), anchor_schema)

    def joined(told: pa.Table, column: str, width: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *[unpack(b, width) for b in told.column(column).to_pylist()]])

    def send_windows(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        chunk = Chunk(rows.column("doc_id"), rows.column("text"))
        shared = np.sort(joined(told, "keys", KEY_BYTES))
        return table(window_rows(chunk, key[0].as_py(), shared, block, window, n_parts), window_schema)

    span = pa.list_(pa.struct([("start", longs), ("length", longs)]))

    def finish(rows: pa.Table, told: pa.Table) -> pa.Table:
        chunk = Chunk(rows.column("doc_id"), rows.column("text"))
        keys, sides = joined(told, "keys", 8), joined(told, "sides", 4)
        says = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(b, np.uint8) for b in told.column("says").to_pylist()]])
        order = np.argsort(keys, kind="stable")
        found = list(results(chunk, covered_words(chunk, keys[order], sides[order], says[order], window)))
        kept = [f[4] for f in found]
        if untouched:
            given = rows.column("text").to_pylist()
            kept = [k if f[1] else t for f, k, t in zip(found, kept, given, strict=True)]
        spans = [[{"start": s, "length": n} for s, n in zip(f[2], f[3], strict=True)] for f in found]
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                **{c: rows.column(c) for c in columns_out},
                "n_words": pa.array([f[0] for f in found], longs),
                "n_removed": pa.array([f[1] for f in found], longs),
                "removed": pa.array(spans, span),
                "kept_text": pa.array(kept, pa.string()),
            }
        )

    anchors = dealt.groupBy("chunk").applyInArrow(send_anchors, "part long, chunk long, keys binary, flags binary")
    shared = anchors.groupBy("part").applyInArrow(answer_anchors, "chunk long, keys binary")
    sent = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk"))
    windows = sent.applyInArrow(
        send_windows, "part long, chunk long, keys binary, sides binary, lows binary, several binary"
    )
    told = windows.groupBy("part").applyInArrow(answer_windows, "chunk long, keys binary, sides binary, says binary")
    schema = T.StructType(
        [
            *[f for f in columns.schema.fields if f.name != "text"],
            *T._parse_datatype_string(
                "n_words long, n_removed long, removed array<struct<start: long, length: long>>, kept_text string"
            ).fields,
        ]
    )
    done = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(finish, schema)
    return done.select("doc_id", *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], *schema.fieldNames()[1 + len(keep) :])
