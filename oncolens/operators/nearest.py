"""Nearest-in-time matching in both directions, ties kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oncolens.functions.columns import day_diff


def match_nearest(days: DataFrame, left: str, right: str, by: Sequence[str] = ()) -> DataFrame:
    """Pair each day's ``left`` values with the ``right`` values of the nearest day(s).

    ``days`` has one row per patient_id, ``by`` and day with two arrays of structs, either
    may be empty. Out come patient_id, day, one ``left`` struct, right_day and one ``right``
    struct per row. Two days equally far before and after both count; values without a
    day count only for patients with no dated ones; with none at all ``right`` is null.

    Instead of pairing every left day with every right day, the days form one timeline
    per patient on which each takes the last right day up to it and the first from it:
    a sort, not a product. The timeline is bounded by the calendar.
    """
    patient = Window.partitionBy(*by, "patient_id")
    upward = patient.orderBy(F.col("day").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    downward = patient.orderBy(F.col("day").desc_nulls_last()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    dated, mark = F.col("day").isNotNull(), F.struct("day", right)
    has_right = F.size(right) > 0
    placed = (
        days.withColumns(
            {
                "before": F.last(F.when(has_right & dated, mark), ignorenulls=True).over(upward),
                "undated": F.last(F.when(has_right & ~dated, mark), ignorenulls=True).over(upward),
            }
        )
        .withColumn("after", F.last(F.when(has_right & dated, mark), ignorenulls=True).over(downward))
        .where(dated & (F.size(left) > 0))
        .withColumns({"back": F.datediff("day", "before.day"), "ahead": F.datediff("after.day", "day")})
    )
    back, ahead = F.col("back"), F.col("ahead")
    # A match on the day itself is seen from both sides; the look ahead then stands back.
    nearest = F.array_compact(
        F.array(
            F.when(ahead.isNull() | (back <= ahead), F.col("before")),
            F.when((back.isNull() | (ahead <= back)) & (ahead > 0), F.col("after")),
            F.when(back.isNull() & ahead.isNull(), F.col("undated")),
        )
    )
    matched = placed.select(*by, "patient_id", "day", left, F.explode_outer(nearest).alias("match"))
    paired = matched.select(
        *by, "patient_id", "day", left, F.col("match.day").alias("right_day"), F.explode_outer(f"match.{right}").alias(right)
    )
    return paired.withColumn(left, F.explode(left))


def nearest_days(left: DataFrame, left_day: str, right: DataFrame, right_day: str, nearest: str) -> DataFrame:
    """Dated ``left`` rows with the day(s) of the same patient's ``right`` nearest to theirs.

    ``left`` should be merged to distinct rows; ``right`` counts by its dated days only.
    """
    empty = F.array().cast("array<struct<mark:boolean>>")
    lefts = left.select("patient_id", F.col(left_day).alias("day"), F.struct(*left.columns).alias("row"))
    rights = right.where(F.col(right_day).isNotNull()).select("patient_id", F.col(right_day).alias("day")).distinct()
    days = (
        lefts.withColumn("marked", F.lit(None).cast("boolean"))
        .unionByName(rights.withColumn("marked", F.lit(True)), allowMissingColumns=True)
        .groupBy("patient_id", "day")
        .agg(F.collect_list("row").alias("row"), F.max("marked").alias("marked"))
        .withColumn("mark", F.when(F.col("marked"), F.array(F.struct(F.col("marked").alias("mark")))).otherwise(empty))
    )
    return match_nearest(days, "row", "mark").select("row.*", F.col("right_day").alias(nearest))


def rank_by_distance(
    rows: DataFrame, keys: Sequence[str], anchor: str, day: str, distance: str, rank: str
) -> DataFrame:
    """Signed days from ``anchor`` to ``day`` and the dense rank of its size, nulls last."""
    order = Window.partitionBy(*keys).orderBy(F.abs(F.col(distance)).asc_nulls_last())
    return rows.withColumn(distance, day_diff(F.col(anchor), F.col(day))).withColumn(
        rank, F.dense_rank().over(order)
    )


def keep_nearest(rows: DataFrame, rank: str = "closest_test") -> DataFrame:
    """Rank 1 only; Spark then drops farther rows before the shuffle as well."""
    return rows.where(F.col(rank) == 1)
