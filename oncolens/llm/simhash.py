"""SimHash near-duplicates by tiled exact comparison of all fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oncolens.llm.common import components, pick, store, tile_pairs, unite
from oncolens.operators.grouping import join_groups

SEED = 42
BITS = 64


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash: a bit is set if more than half of the shingles' hashes have it."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII space parts words
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)), np.uint64, n
    )
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 16):
        part = hashes[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_column: str, keep: list[str], shingle: int = 4) -> DataFrame:
    """The columns ``keep`` and ``fp``, the text's fingerprint as a signed long. A null text has fp 0."""
    rows = docs.select(*keep, F.col(text_column).alias("simhash_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(len(keep))], np.uint64)
            columns = [*batch.columns[: len(keep)], pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "fp"])

    return rows.mapInArrow(run, schema)


def plan_tiles(counts: dict[int, int], radius: int, tile_size: int) -> list[tuple[int, int, int, int]]:
    """For each population count 0 to 64: first tile, number of tiles, lowest and highest partner tile.

    Neighbouring counts share a tile until it is full; a count too large for one is
    dealt over several. Tiles further apart than ``radius`` in every count never meet.
    """
    spans, tile, open_rows, low = [], -1, tile_size, 0
    groups: list[list[int]] = []  # lowest count, highest count, first tile, tiles
    for pop in range(BITS + 1):
        n = counts.get(pop, 0)
        if groups and open_rows + n <= tile_size:
            open_rows += n
            groups[-1][1] = pop
        else:
            parts = max(1, -(-n // tile_size))
            groups.append([pop, pop, tile + 1, parts])
            tile, open_rows = tile + parts, n if parts == 1 else tile_size
    for pop in range(BITS + 1):
        low, high, first, parts = next(g for g in groups if g[0] <= pop <= g[1])
        near = [g for g in groups if g[0] - high <= radius and low - g[1] <= radius]
        spans.append((first, parts, min(g[2] for g in near), max(g[2] + g[3] - 1 for g in near)))
    return spans


def linked(left: np.ndarray, right: np.ndarray, radius: int, block: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``radius`` bits, block by block."""
    rows = max(1, block // max(1, len(right)))
    for k in range(0, len(left), rows):
        i, j = np.nonzero(np.bitwise_count(left[k : k + rows, None] ^ right[None, :]) <= radius)
        yield i + k, j


def links(distinct: DataFrame, radius: int, tile_size: int) -> DataFrame:
    """(a, b): enough links between the distinct fingerprints ``fp`` to join whatever the radius joins.

    Every pair in reach is compared; of the pairs found in two tiles a spanning forest
    goes out, so a dense group costs a row per fingerprint and tile pair, not per pair.
    """
    pop = F.bit_count("fp")
    counts = {r[0]: r[1] for r in distinct.groupBy(pop.alias("pop")).count().collect()}  # 65 rows at most
    first, parts, low, high = (
        F.array(*[F.lit(int(v)) for v in column]) for column in zip(*plan_tiles(counts, radius, tile_size), strict=True)
    )
    placed = distinct.withColumn("pop", pop).select(
        "fp",
        (F.get(first, "pop") + F.pmod(F.xxhash64("fp"), F.get(parts, "pop")).cast("int")).alias("tile"),
        F.get(low, "pop").alias("low"),
        F.get(high, "pop").alias("high"),
    )
    tiles = placed.groupBy("tile", "low", "high").agg(F.collect_list("fp").alias("fps"))
    paired = tile_pairs(tiles, F.col("low"), F.col("high"), ["fps"])

    def compare(pair: pa.Table) -> pa.Table:
        sides = [np.asarray(x.values).view(np.uint64) for x in pair.column("fps")]
        parent = np.arange(sum(map(len, sides)), dtype=np.int64)
        other = len(sides[0]) if len(sides) == 2 else 0
        for i, j in linked(sides[0], sides[-1], radius):
            unite(parent, i, j + other)
        nodes = np.concatenate(sides).view(np.int64)
        joined = np.flatnonzero(parent != np.arange(len(parent)))
        return pa.table({"a": nodes[joined], "b": nodes[parent[joined]]})

    return paired.groupBy("a", "b").applyInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 4,
    radius: int = 4,
    tile_size: int = 16384,
) -> DataFrame:
    """(id, fp, component, root) for every row of ``docs``.

    ``component`` is the smallest id reachable over fingerprints at most ``radius`` bits
    apart, ``root`` a fingerprint that names the component. Null and empty texts have
    fingerprint 0 and are linked like any other; equal rows share a component; null ids
    stay and are never the smallest, so a component of null ids only is named null.
    An empty table gives no rows.
    """
    columns = pick(docs, id=id_column, text=text_column)
    marked = store(fingerprints(columns, "text", ["id"], shingle), "fingerprints")
    distinct = store(marked.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), radius, tile_size), "links")
    members = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = members.groupBy("root").agg(F.min("first").alias("component"))
    return marked.join(join_groups(members.drop("first"), named, ["root"], "inner"), "fp").select("id", "fp", "component", "root")


def keep_one(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """One row of ``docs`` for each component: a row with the component's smallest id.

    Rows that repeat an id are documents of their own, so several rows of one id stay if
    they are in different components. Of a component's rows with its smallest id, the
    smallest fingerprint's stays, and of those with that the one with the smallest text.
    Rows without an id go, unless nothing in their component has one.
    Only rows without an id, or whose id is repeated, have their fingerprint made again.
    """
    found = near_duplicates(docs, id_column, text_column, shingle, radius)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = (f"c{names.index(c)}" for c in (id_column, text_column))
    smallest = F.col("id").eqNullSafe(F.col("component"))
    ids = found.where("id IS NOT NULL").groupBy(F.col("id").alias(key)).agg(
        F.count("*").alias("n_rows"), F.max(smallest).alias("smallest")
    )
    ids = store(ids.where("smallest"), "ids")
    # By sorting, whatever the list's size: its work then grows evenly with the input and no threshold changes it.
    once = ids.where("n_rows = 1").select(key).hint("merge")
    first = plain.join(once, key, "left_semi").select(*plain.columns)
    again = plain.where(F.col(key).isNull())
    if not ids.where("n_rows > 1").isEmpty():
        again = again.unionByName(plain.join(ids.where("n_rows > 1").select(key), key, "left_semi").select(*plain.columns))
    chosen = found.where(smallest).groupBy(F.col("id").alias(key), "root").agg(F.min("fp").alias("fp")).select(key, "fp")
    rest = join_groups(fingerprints(again, text, plain.columns, shingle), chosen, [key, "fp"], "left_semi")
    row = F.min_by(F.struct(*plain.columns), F.struct(text)).alias("row")
    rest = rest.groupBy(F.col(key).alias("id"), "fp").agg(row).select("row.*")
    return first.unionByName(rest).toDF(*names)
