"""Periodic runs of words, by maximal pairs over the LCP-interval tree.

A stretch of period q and length l, extended as far as it goes, is two equal pieces of
length l - q that start q words apart and can be prolonged on neither side: a maximal
pair. So runs need no extension: they are the maximal pairs whose distance is small
beside their length. Pairs are read off the tree of LCP intervals from the bottom up. An
interval's positions are all occurrences of one piece; where two children meet, a pair
across them has exactly the interval's length and can't be prolonged to the right, and
it can't be prolonged to the left if the words before differ, which is the pair's class.

Where distances are at most the length, a pair that is not adjacent among the interval's
positions has a multiple of the stretch's smallest period. So each list of positions is
kept in order, with the class of each, and only new neighbours of unequal class are looked
at: every run is found once, by its smallest period.

Documents are independent: Spark hands each task its batches, and a batch's documents are
ranked together in arrays.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oncolens.llm.common import Numbers, byte_groups, pick

GROUP_BYTES = 4 << 20
BLOCK = 1024


class Places:
    """Positions in ascending order, in blocks, so that a large list takes an insertion as fast as a small one."""

    def __init__(self, place: int):
        self.blocks, self.heads, self.n = [[place]], [place], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, place: int) -> tuple[int | None, int | None]:
        """Inserts ``place``, which is not there yet, and returns its neighbours."""
        b = max(0, bisect_left(self.heads, place) - 1)
        block = self.blocks[b]
        k = bisect_left(block, place)
        before = block[k - 1] if k else None
        after = block[k] if k < len(block) else self.heads[b + 1] if b + 1 < len(self.heads) else None
        insort(block, place)
        self.heads[b] = block[0]
        self.n += 1
        if len(block) > 2 * BLOCK:
            self.blocks[b : b + 1] = [block[:BLOCK], block[BLOCK:]]
            self.heads[b : b + 1] = [block[0], block[BLOCK]]
        return before, after


def ranks(words: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For 1, 2, 4, ... words from each position on, a number that is equal where they are, within a document.

    ``ends`` is where each position's document ends. Only positions that are not yet alone
    with their number are sorted again; at last all are. Numbers order the suffixes.
    """
    n = len(words)
    key = doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    head = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))
    start = np.flatnonzero(head)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))
    levels, width = [rank], 1
    active = order[np.repeat(np.diff(np.append(start, n)) > 1, np.diff(np.append(start, n)))]
    while len(active):
        old, beyond = rank[active].astype(np.int64), active + width
        second = np.where(beyond < ends[active], rank[np.minimum(beyond, n - 1)], -1) + 1
        key = old * (n + 1) + second
        order = np.argsort(key, kind="stable")
        active, key, old = active[order], key[order], old[order]
        head = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.concatenate(([True], old[1:] != old[:-1]))
        start = np.flatnonzero(head)
        size = np.diff(np.append(start, len(active)))
        group = np.maximum.accumulate(np.where(first, np.arange(len(active)), 0))
        rank = rank.copy()
        rank[active] = old + np.repeat(start, size) - group
        levels.append(rank)
        active = active[np.repeat(size > 1, size)]
        width *= 2
    return levels


def common_lengths(levels: list[np.ndarray], ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``a`` and ``b`` of the same documents share."""
    total = np.zeros(len(a), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        x, y = a + total, b + total
        inside = (x < ends[a]) & (y < ends[b])
        last = len(ends) - 1
        same = inside & (levels[t][np.minimum(x, last)] == levels[t][np.minimum(y, last)])
        total[same] += 1 << t
    return total


def least_common(exponent: int, shortest: int) -> int:
    """The shortest piece that a run can be a maximal pair of."""
    return min(max(shortest - q, (exponent - 1) * q) for q in range(1, shortest + 1))


def runs_in_cluster(
    places: list[int], shared: list[int], left: np.ndarray, exponent: int, shortest: int
) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) from suffixes in order; shared[k] is what places[k] shares with the one before it."""
    stack: list[tuple[Places, int]] = []

    def merged(one: Places, other: Places, common: int) -> Iterator[tuple[int, int, int]]:
        """Moves the smaller list into the larger. Yields the pairs of new neighbours that are runs."""
        few, many = (one, other) if one.n < other.n else (other, one)
        small = list(few)
        for k, place in enumerate(small):
            before, after = many.add(place)
            if before is not None and (not k or before != small[k - 1]):
                yield before, common, place
            if after is not None and (k + 1 == len(small) or after < small[k + 1]):
                yield place, common, after

    def fold(common: int) -> Iterator[tuple[int, int, int]]:
        """Closes the intervals that share at least ``common``."""
        while len(stack) > 1 and stack[-1][1] >= common:
            (top, length), (below, under) = stack.pop(), stack.pop()
            for a, piece, b in merged(below, top, length):
                period = b - a
                if (exponent - 1) * period <= piece and piece + period >= shortest and left[a] != left[b]:
                    yield a, piece + period, period
            stack.append((below if below.n > top.n else top, under))

    for place, common in zip(places, shared, strict=True):
        yield from fold(common)
        stack.append((Places(place), common))
    yield from fold(0)


def find_runs(words: np.ndarray, doc: np.ndarray, exponent: int = 4, shortest: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, in no order; documents lie one after another and starts count over all."""
    n = len(words)
    if not n:
        return []
    sizes = np.bincount(doc, minlength=int(doc[-1]) + 1)
    first = np.cumsum(sizes) - sizes
    ends = (first + sizes)[doc]
    left = np.concatenate(([-1], words[:-1])).astype(np.int64)
    left[first[sizes > 0]] = -1
    levels = ranks(words, doc, ends)
    suffixes = np.empty(n, np.int64)
    suffixes[levels[-1]] = np.arange(n)
    least = least_common(exponent, shortest)
    level = min(least.bit_length() - 1, len(levels) - 1)  # its pieces are not longer than ``least``
    near = np.flatnonzero(levels[level][suffixes[1:]] == levels[level][suffixes[:-1]]) + 1
    shared = np.zeros(n + 1, np.int64)
    shared[near] = common_lengths(levels, ends, suffixes[near - 1], suffixes[near])
    linked = shared >= least
    members = np.flatnonzero(linked[:-1] | linked[1:])
    if not len(members):
        return []
    # A cluster: suffixes in a row that share ``least`` words. Most hold no run, seen without their tree: all of
    # one class, or all too far apart.
    cluster = np.cumsum(~linked[members]) - 1
    begin = np.flatnonzero(~linked[members])
    at = suffixes[members]
    longest = np.maximum.reduceat(np.where(linked[members], shared[members], 0), begin)
    classes = np.maximum.reduceat(left[at], begin) != np.minimum.reduceat(left[at], begin)
    order = np.lexsort((at, cluster))
    gaps = np.where(np.diff(cluster[order], prepend=-1) == 0, np.diff(at[order], prepend=0), n)
    close = np.minimum.reduceat(gaps, begin) * (exponent - 1) <= longest
    stops = np.append(begin[1:], len(members))
    found = []
    for c in np.flatnonzero(classes & close):
        own = slice(begin[c], stops[c])
        lengths = shared[members[own]]
        lengths[0] = 0
        found += runs_in_cluster(at[own].tolist(), lengths.tolist(), left, exponent, shortest)
    return found


def judged(texts: list[str | None], exponent: int, shortest: int) -> list[tuple[int, list[dict[str, int]], str]]:
    """Per text: its number of words, its runs by start and period, its words without the runs' repetitions."""
    split = [(t or "").encode().split() for t in texts]  # bytes: ASCII white space alone
    counts = np.array([len(ws) for ws in split], np.int64)
    words = np.fromiter(map(Numbers().__getitem__, chain.from_iterable(split)), np.int64, counts.sum())
    first = np.cumsum(counts) - counts
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = find_runs(words, np.repeat(np.arange(len(texts)), counts), exponent, shortest)
    owners = np.searchsorted(first + counts, [f[0] for f in found], side="right").tolist()
    for (start, length, period), d in zip(found, owners, strict=True):
        runs[d].append((start - int(first[d]), length, period))
    out = []
    for ws, own in zip(split, runs, strict=True):
        own.sort(key=lambda r: (r[0], r[2]))
        if own:
            change = np.zeros(len(ws) + 1, np.int64)
            for start, length, period in own:
                change[start + period] += 1
                change[start + length] -= 1
            ws = [w for w, gone in zip(ws, (np.cumsum(change) > 0).tolist(), strict=False) if not gone]
        spans = [{"start": s, "length": n, "period": q} for s, n, q in own]
        out.append((int(counts[len(out)]), spans, b" ".join(ws).decode()))
    return out


def periodic_runs(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", exponent: int = 4, shortest: int = 6
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs, collapsed.

    Words are runs of anything but ASCII white space. A run is a stretch of words with
    smallest period q, at least ``exponent`` (2 or more) times q and ``shortest`` words
    long, that no neighbouring word extends. ``runs`` lists (start, length, period) by
    start and period; ``collapsed`` is the text, its words joined by one space, without
    the words that some run holds after its first q.

    A null text has no words; ids may be null, repeat and be of any type. An empty table
    gives no rows. Nothing is shuffled; a task holds one batch and at least one whole text.
    """
    columns = pick(docs, doc_id=id_column, text=text_column)
    kinds = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    schema = T.StructType([columns.schema["doc_id"], *T._parse_datatype_string(kinds).fields])
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in byte_groups([len(t or "") for t in texts], GROUP_BYTES):
                found = judged(texts[part], exponent, shortest)
                columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), span, pa.string()))]
                ids = batch.column(0).slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([ids, *columns], schema.names)

    return columns.mapInArrow(run, schema)


def with_repetition(text: Column, draw: Column) -> Column:
    """``text`` with its words from a place on repeated from there, place and period drawn by ``draw`` (a whole number).

    Word i >= a becomes word a + (i - a) % p, where of n words a = draw % n and
    p = 1 + floor((n - a) / (3 + draw % 8)). A text without words stays.
    """

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = draw % n
        p = 1 + F.floor((n - a) / (3 + draw % 8))
        places = F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
        picked = F.transform(places, lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(picked, " ")).otherwise(text)

    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.get(F.transform(F.array(words), repeated), 0)
