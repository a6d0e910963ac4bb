"""Embedding near-duplicates by PCA-ordered tiled comparison, exact over all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oncolens.llm.common import components, pick, store, tile_pairs, unite
from oncolens.operators.grouping import join_groups

SLACK = 1e-9  # rounding of rotated and partial products; what it lets through is compared again, unrotated
FEW = 0.02


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow on the way."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def basis(sample: np.ndarray) -> np.ndarray:
    """Orthonormal columns, the directions of largest mean square first. Any orthonormal basis gives the same result."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1]


def levels(width: int) -> list[int]:
    """Leading dimensions after which the bound is tried: an eighth, a quarter, a half."""
    return sorted({max(1, width // k) for k in (8, 4, 2)} - {width})


def tails(rotated: np.ndarray, at: list[int]) -> list[np.ndarray]:
    return [np.sqrt(np.einsum("ij,ij->i", rotated[:, k:], rotated[:, k:])) for k in at]


def reaching(left: tuple, right: tuple, at: list[int], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two blocks with a cosine of at least ``least``.

    A block is (unit rows, rotated rows, suffix norms). The product of the leading
    dimensions plus the product of the suffix norms bounds the cosine; a pair below
    ``least`` is finished, and so is a block when all its pairs are.
    """
    x, rx, tx = left
    y, ry, ty = right
    done, partial, pairs = 0, None, None
    for k, u, v in zip(at, tx, ty, strict=True):
        if pairs is None:
            step = rx[:, done:k] @ ry[:, done:k].T
            partial = step if partial is None else partial + step
            near = partial + u[:, None] * v[None, :] >= least - SLACK
            n = np.count_nonzero(near)
            if not n:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            if n < FEW * near.size:
                pairs = np.nonzero(near)
                partial = partial[pairs]
        else:
            i, j = pairs
            partial = partial + np.einsum("ij,ij->i", rx[i, done:k], ry[j, done:k])
            near = partial + u[i] * v[j] >= least - SLACK
            pairs, partial = (i[near], j[near]), partial[near]
        done = k
    if pairs is None:
        return np.nonzero(x @ y.T >= least)
    i, j = pairs
    near = np.einsum("ij,ij->i", x[i], y[j]) >= least
    return i[near], j[near]


def compare(ids: list, weights: list, vectors: list, turn: np.ndarray, least: float, block: int) -> dict[str, np.ndarray]:
    """Links between two tiles, or inside one: per linked vector its number of links and a root it is joined to."""
    at = levels(len(turn))
    sides = []
    for v in vectors:
        x = unit(v)
        r = x @ turn
        sides.append([(k, (x[k : k + block], r[k : k + block], [t[k : k + block] for t in tails(r, at)])) for k in range(0, len(x), block)])
    node, weight = np.concatenate(ids), np.concatenate(weights)
    count, parent = np.zeros(len(node), np.int64), np.arange(len(node))
    alone = len(ids) == 1
    shift = 0 if alone else len(ids[0])
    for a, left in sides[0]:
        for b, right in sides[-1]:
            if alone and b < a:
                continue
            i, j = reaching(left, right, at, least)
            i, j = i + a, j + b + shift
            if alone and a == b:
                i, j = i[i < j], j[i < j]
            np.add.at(count, i, weight[j])
            np.add.at(count, j, weight[i])
            unite(parent, i, j)
    linked = np.flatnonzero(count)
    return {"node": node[linked], "links": count[linked], "root": node[parent[linked]]}


def near_duplicates(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    least: float = 0.9,
    tile_size: int = 8192,
    sample_size: int = 4096,
    block: int = 1024,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row; links join vectors with a cosine of at least ``least``.

    Equal vectors are compared once and counted as often as they occur. Every pair of
    different vectors meets in one pair of tiles, which sends back a count and one link
    per vector, never its pairs. ``component_id`` is the smallest id reachable, ``kept``
    whether that is the row's own.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, nor do vectors of different lengths with each other. Rows that repeat an id
    are vectors of their own; null ids are never the smallest while there is another. An
    empty table gives no rows. The rotation is fitted on about ``sample_size`` vectors of
    each length; it decides how early comparisons stop, not what they find.
    """
    rows = pick(vectors, vec_id=id_column, vector=vector_column)
    whole = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(whole & F.exists("vector", lambda v: v != 0), F.lit(False))
    good = rows.where(usable)
    classes = good.groupBy("vector").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"))
    classes = store(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    widths = dict(classes.groupBy(F.size("vector").alias("width")).count().collect())
    first, spans, turns = 0, {}, {}
    for width in sorted(widths):
        tiles = -(-widths[width] // tile_size)
        spans[width] = (first, tiles)
        first += tiles
        share = min(1.0, sample_size / widths[width])
        picked = classes.where((F.size("vector") == width) & (F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
        sample = np.array([r[0] for r in picked.select("vector").collect()], float).reshape(-1, width)
        turns[width] = basis(unit(sample)) if len(sample) else np.eye(width)
    if not widths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    start, tiles = (F.element_at(F.create_map(*[F.lit(int(v)) for w, s in spans.items() for v in (w, s[k])]), F.size("vector")) for k in (0, 1))
    placed = classes.select(
        (start + F.pmod(F.xxhash64("node"), tiles).cast("int")).alias("tile"),
        start.alias("low"),
        (start + tiles - 1).alias("high"),
        F.struct("node", "weight", "vector").alias("item"),
    )
    packed = placed.groupBy("tile", "low", "high").agg(F.collect_list("item").alias("items"))

    def run(pair: pa.Table) -> pa.Table:
        ids, weights, found = [], [], []
        for items in pair.column("items"):
            node, weight, vector = (items.values.field(k) for k in range(3))
            ids.append(node.to_numpy())
            weights.append(weight.to_numpy())
            found.append(vector.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(node), -1))
        return pa.table(compare(ids, weights, found, turns[found[0].shape[1]], least, block))

    met = tile_pairs(packed, F.col("low"), F.col("high"), ["items"]).groupBy("a", "b")
    met = store(met.applyInArrow(run, "node long, links long, root long"), "met")
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "links")
    members = classes.join(counts, "node", "left").join(roots, "node", "left").select(
        "vector",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("root"),
        "first",
    )
    members = store(members, "members")
    named = members.groupBy("root").agg(F.min("first").alias("component_id"))
    found = good.join(join_groups(members, named, ["root"], "inner").select("vector", "n_links", "component_id"), "vector")
    bad = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (
        found.select("vec_id", "n_links", "component_id")
        .unionByName(bad)
        .select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )
