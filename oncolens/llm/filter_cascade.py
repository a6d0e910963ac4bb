"""URL rules looked up in Bloom filter cascades that are exact over the corpus's own keys."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oncolens.llm.common import pick, store

PARTS = regex.compile(r"://([^/?#]*)([^?#]*)", regex.DOTALL)
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ALLOW, BLOCK = "allow", "block"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null and for a URL without ://."""
    found = PARTS.search(url or "")
    return (found[1].translate(UPPER), found[2]) if found else ("", "")


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def candidates(host: str, path: str, path_lengths: tuple[int, ...], most_labels: int) -> list[str]:
    """Every rule that could fit: each parent domain with each beginning of the path of a listed length.

    Parent domains have ``most_labels`` labels at most, as no listed host has more; so the
    keys of a host of a million labels stay about as long as the host. Longest first; of
    equal lengths the longer host first. The key is the rule as written.
    """
    labels = host.rsplit(".", most_labels)
    hosts = [".".join(labels[k:]) for k in range(max(0, len(labels) - most_labels), len(labels))] if host else []
    keys = [(h, path[:n]) for h in hosts if h for n in path_lengths if n <= len(path)]
    return [h + p for h, p in sorted(keys, key=lambda k: (-len(k[0]) - len(k[1]), -len(k[0])))]


@dataclass(frozen=True)
class Bloom:
    seed: int
    size: int
    hashes: int
    bits: bytes

    @staticmethod
    def shape(n: int, miss: float) -> tuple[int, int]:
        """Bits and hashes for ``n`` keys and a false-positive rate of about ``miss``."""
        return max(8, math.ceil(n * math.log2(1 / miss) / math.log(2))), max(1, round(math.log2(1 / miss)))

    @staticmethod
    def places(key: str, seed: int, size: int, hashes: int) -> list[int]:
        h = xxhash.xxh64_intdigest(key.encode(), seed)
        step = (h >> 32) | 1
        return [((h & 0xFFFFFFFF) + k * step) % size for k in range(hashes)]

    def __contains__(self, key: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.places(key, self.seed, self.size, self.hashes))


def build(keys: DataFrame, n: int, miss: float, seed: int) -> Bloom:
    """A filter of the ``n`` rows of ``keys`` (key): tasks make the places, the driver gets each used byte once."""
    size, hashes = Bloom.shape(n, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([p for k in batch.column(0).to_pylist() for p in Bloom.places(k, seed, size, hashes)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 3), pa.array(1 << (at & 7))], ["at", "bit"])

    bits = bytearray((size + 7) // 8)
    for at, bit in keys.mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit")).collect():
        bits[at] = bit
    return Bloom(seed, size, hashes, bytes(bits))


def passing(keys: DataFrame, bloom: Bloom) -> DataFrame:
    """The rows of ``keys`` (key) that the filter takes for its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([k in bloom for k in batch.column(0).to_pylist()], pa.bool_()))

    return keys.mapInArrow(run, "key string")


@dataclass(frozen=True)
class Cascade:
    """Filters that hold, in turn, listed keys and the unlisted ones the filter before took for listed."""

    levels: tuple[Bloom, ...]

    def __contains__(self, key: str) -> bool:
        for k, bloom in enumerate(self.levels):
            if key not in bloom:
                return k % 2 == 1
        return len(self.levels) % 2 == 1


def cascade(universe: DataFrame, listed: DataFrame, name: str) -> Cascade:
    """The cascade that answers rightly for every key of ``universe``; both have a distinct column key.

    The first filter's error rate makes its false positives about as many as the listed
    keys, so all levels together take a few bytes per listed key, however large the corpus.
    """
    inside = store(universe.join(listed, "key", "left_semi"), name)
    n, total = inside.count(), universe.count()
    if not n:
        return Cascade(())
    levels = [build(inside, n, min(0.5, max(1e-9, n / (1.4 * total))), 0)]
    mine = store(passing(universe, levels[0]).join(inside, "key", "left_anti"), name)  # to encode next
    other = inside
    while n := mine.count():
        levels.append(build(mine, n, 0.5, len(levels)))
        mine, other = store(passing(other, levels[-1]), name), mine
    return Cascade(tuple(levels))


def judge(
    pages: DataFrame,
    allow: Iterable[str],
    block: Iterable[str],
    id_column: str = "page_id",
    url_column: str = "url",
    otherwise: str = ALLOW,
    most_bytes: int = 64 << 20,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row: the longest rule that fits a URL, and what it says.

    A rule ``host/path`` fits its host and all subdomains where the URL's path begins with
    the rule's. Of equally long rules the one with the longer host wins; a rule on both
    lists blocks. Where none fits, the rule is null and the verdict ``otherwise``: a list
    says nothing about what is not on it. Null URLs and those without :// have an empty
    host and path, which no rule fits. Rows repeat as they come; an empty table gives none.

    The keys a corpus can ask for (parent domains with path beginnings) are gathered once
    and each list becomes a cascade without error on them, looked up without any join.
    Cascades take a few bytes per rule; lists that would need more than ``most_bytes``
    are refused, to be given in several calls.
    """
    allow, block = sorted(set(allow) - set(block)), sorted(set(block))
    if 16 * (len(allow) + len(block)) > most_bytes:
        raise ValueError(f"{len(allow) + len(block)} rules do not fit {most_bytes} bytes; judge them in several calls")
    lengths = tuple(sorted({len(split_rule(r)[1]) for r in [*allow, *block]}))
    most_labels = max((split_rule(r)[0].count(".") + 1 for r in [*allow, *block]), default=1)
    columns = pick(pages, page_id=id_column, url=url_column)
    spark = pages.sparkSession

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = {k for u in batch.column(0).to_pylist() for k in candidates(*split_url(u), lengths, most_labels)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(keys), pa.string())], ["key"])

    universe = store(columns.select("url").mapInArrow(ask, "key string").distinct(), "universe")
    blocked, allowed = (
        cascade(universe, spark.createDataFrame([(r,) for r in rules], "key string"), name)
        for name, rules in (("blocked", block), ("allowed", allow))
    )
    schema = T.StructType(
        [columns.schema["page_id"], *T._parse_datatype_string("host string, path string, rule string, verdict string").fields]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule, verdict = None, otherwise
                for key in candidates(host, path, lengths, most_labels):
                    if key in blocked or key in allowed:
                        rule, verdict = key, BLOCK if key in blocked else ALLOW
                        break
                out.append((host, path, rule, verdict))
            columns = [pa.array([o[k] for o in out], pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema.names)

    return columns.mapInArrow(run, schema)
