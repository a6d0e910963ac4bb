"""What several corpus operators share: column picking, stored stages, ranks, components, union-find."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oncolens.operators.grouping import join_groups


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """``alias=column`` pairs and nothing else.

    Columns are found by exact name, so other columns may have any name, also one
    that differs only in case or that an operator uses itself.
    """
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{names.index(column)}").alias(alias) for alias, column in wanted.items()])


@cache
def local_folder() -> str:
    return tempfile.mkdtemp(prefix="stages-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local session without one gets its own, a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = local_folder()
    return folder.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may not have it installed; once per application."""
    context = spark.sparkContext
    if not any(name.startswith("oncolens-") for name in context._python_includes):
        root = Path(__file__).resolve().parents[2]
        name = str(Path(tempfile.mkdtemp(prefix="ship-")) / f"oncolens-{uuid.uuid4().hex}")
        context.addPyFile(shutil.make_archive(name, "zip", root, "oncolens"))


def byte_groups(sizes: list[int], most: int) -> Iterator[slice]:
    """Neighbouring items of ``most`` bytes together, or one that is larger."""
    start = total = 0
    for k, size in enumerate(sizes):
        if k > start and total + size > most:
            yield slice(start, k)
            start, total = k, 0
        total += size
    if sizes:
        yield slice(start, len(sizes))


class Numbers(dict):
    """Numbers its keys from 0 as they are first asked for."""

    def __missing__(self, key) -> int:
        found = self[key] = len(self)
        return found


def held_out(id_column: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; ids that are null are not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def cell(n_cells: int, *columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n_cells)).cast("int")


def numbered(df: DataFrame, group: list[str], cells: list[str], order: list[str], rank: str) -> DataFrame:
    """Adds ``rank``: a gapless number from 0 within each group.

    Rows of a group are numbered cell by cell, so no task holds a whole group; only
    the cells' counts meet in one place. ``df`` is read twice and must be stored.
    """
    counts = df.groupBy(*group, *cells).agg(F.count("*").alias("cell_rows"))
    before = Window.partitionBy(*group).orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("cell_start", F.coalesce(F.sum("cell_rows").over(before), F.lit(0)))
    inside = Window.partitionBy(*group, *cells).orderBy(*order)
    keys = [*group, *cells]
    return (
        df.join(starts.drop("cell_rows"), keys)
        .withColumn(rank, F.col("cell_start") + F.row_number().over(inside) - 1)
        .drop("cell_start")
    )


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long), root being the smallest node reachable.

    Rounds of large-star and small-star. Neighbours are reduced by a minimum that
    combines map-side and joined back over a shuffle of its own, so a hub with a third of all links is split
    by the join and never gathered. Each round is stored; the last two are equal.
    """
    edges = store(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name
    )
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").transform(join_groups, low, ["a"], "inner")
        large = large.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = join_groups(large, low, ["a"], "inner").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        edges = store(small.unionByName(low.withColumnRenamed("low", "b")).distinct(), name)


def unite(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Union-find step over whole arrays: afterwards left[i] and right[i] share a root, and every parent is a root."""
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def tile_pairs(tiles: DataFrame, low: Column, high: Column, payload: list[str]) -> DataFrame:
    """Each tile once beside every partner numbered ``low`` to ``high``; rows to be grouped by (a, b).

    ``tiles`` has one row per tile (column ``tile``), its vectors or keys packed into
    arrays of a fixed most size. A pair of tiles is two rows, a tile with itself one.
    The partner ranges must be mutual.
    """
    return tiles.select("tile", *payload, F.explode(F.sequence(low, high)).alias("partner")).select(
        F.least("tile", "partner").alias("a"), F.greatest("tile", "partner").alias("b"), "tile", *payload
    )
