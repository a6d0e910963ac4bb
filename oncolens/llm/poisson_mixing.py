"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oncolens.llm.common import store

BLOCK = 1024


def uniform(seed: int, *parts: Column) -> Column:
    """52 bits of an MD5 over seed and parts, as a whole number; a null part counts as empty."""
    text = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def cumulative(rate: float) -> tuple[int, list[float]]:
    """First count that matters and P(count <= k) from there until nothing is left of a Poisson's tail."""
    if rate <= 0:
        return 0, [1.0]
    width = 12 * math.sqrt(rate) + 30
    first, last = max(0, int(rate - width)), int(rate + width)
    logs = [k * math.log(rate) - rate - math.lgamma(k + 1) for k in range(first, last + 1)]
    return first, np.cumsum(np.exp(logs)).tolist()


def rates(docs: DataFrame, text_column: str, source_column: str, weights: dict | None, power: float) -> DataFrame:
    """(source, rate, first, cdf): the mean number of copies per source, and its distribution.

    A source's size is its code points plus one per document. Its target is its entry in
    ``weights`` (sources without one get 0) or, without weights, its size to the ``power``.
    Expected output and input are equal in size. Null is a source of its own.
    """
    sizes = docs.groupBy(F.col(source_column).alias("source")).agg(
        F.sum(F.coalesce(F.length(text_column), F.lit(0)) + 1).cast("double").alias("size")
    )
    if weights is None:
        weight = F.pow("size", F.lit(power))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(value)).otherwise(weight)
    sizes = store(sizes.withColumn("weight", weight), "sizes")
    size, total = sizes.agg(F.sum("size"), F.sum("weight")).first()

    @F.pandas_udf("first long, cdf array<double>")
    def table(rate: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cumulative(r) for r in rate], columns=["first", "cdf"])

    scale = (size or 0.0) / total if total else 0.0
    rate = F.col("weight") * F.lit(scale) / F.col("size")
    return store(sizes.select("source", rate.alias("rate")).select("source", "rate", table("rate").alias("t")).select("source", "rate", "t.*"), "rates")


def replicate(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: dict | None = None,
    power: float = 0.7,
    seed: int = 7,
) -> DataFrame:
    """``docs`` with each row as often as its Poisson count says, and copy, copies, rate, shuffle_key.

    The count inverts the distribution of the source's rate at a uniform number hashed
    from seed and id, so it does not depend on order, partitions or retries; rows that
    repeat an id have the same count. Rows are dealt over all partitions by the hash of
    (seed, id, copy) and sorted by it there: a global shuffle. A row without an id draws by
    its text, its source and its number in the input instead, which must be the same
    whenever the row is read, as it is from files; so such rows are drawn one by one, even
    equal ones. Null and empty texts are replicated like others. Columns named like the
    four new ones are replaced; others may have any name. An empty table, or weights that
    sum to 0, gives no rows.

    A row with many copies is written out in blocks of 1024, so none is held at once.
    The table of rates has one row per source; Spark broadcasts it below its threshold.
    """
    new = ("copy", "copies", "rate", "shuffle_key")
    names = docs.columns
    keep = [i for i, c in enumerate(names) if c.lower() not in new]
    kept = [f"c{i}" for i in keep]
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # so that no name clashes with those used here
    id_name, text_name, source_name = (f"c{names.index(c)}" for c in (id_column, text_column, source_column))
    rated = rates(plain, text_name, source_name, weights, power).withColumnRenamed("source", "rated_source")
    place = F.concat_ws(
        "/", F.lit("row"), F.xxhash64(text_name, source_name).cast("string"), F.monotonically_increasing_id().cast("string")
    )
    drawn = plain.withColumn("draw_id", F.coalesce(F.col(id_name).cast("string"), place))
    drawn = drawn.withColumn("u", uniform(seed, F.col("draw_id")) / F.lit(float(1 << 52)))
    counted = drawn.join(rated, F.col(source_name).eqNullSafe(F.col("rated_source")))
    copies = (F.col("first") + F.size(F.filter("cdf", lambda c: c <= F.col("u")))).cast("long")
    counted = counted.select(*kept, "draw_id", "rate", copies.alias("copies")).where("copies > 0")
    blocks = counted.withColumn("block", F.explode(F.expr(f"sequence(0L, (copies - 1) div {BLOCK})")))
    last = f"least(copies, (block + 1) * {BLOCK}) - 1"
    rows = blocks.withColumn("copy", F.explode(F.expr(f"sequence(block * {BLOCK}, {last})")))
    key = uniform(seed + 1, F.col("draw_id"), F.col("copy")).alias("shuffle_key")
    rows = rows.select(*kept, "rate", "copies", "copy", key)
    shuffled = rows.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return shuffled.toDF(*[names[i] for i in keep], "rate", "copies", "copy", "shuffle_key")
