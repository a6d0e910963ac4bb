"""Group-wise building blocks that stay safe when one key holds most of the rows.

A window over raw rows sends a whole group to one task. Two ways round it: an
aggregate, which combines map-side, joined back to the rows (the row side is then an
ordinary skewed side that adaptive execution splits); or, where the rows themselves
are not the answer, merging copies first and using the window on what is left.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oncolens.functions.columns import all_of, any_of


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join ``groups`` (one row per group) to ``rows`` with null keys equal to null keys."""
    renamed = groups.select(
        *[F.col(k).alias(f"group_{k}") for k in keys], *[c for c in groups.columns if c not in keys]
    )
    same = all_of(F.col(k).eqNullSafe(F.col(f"group_{k}")) for k in keys)
    joined = rows.join(renamed, same, how)
    return joined.drop(*[f"group_{k}" for k in keys])


def group_stats(rows: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Every row with aggregates of its whole group, as an unordered window would give."""
    stats = rows.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggregates.items()])
    return join_groups(rows, stats, keys, "inner")


def merge_copies(rows: DataFrame, *columns: str) -> DataFrame:
    """Distinct values of ``columns`` with how many rows each stands for in ``n_rows``."""
    n = F.sum("n_rows") if "n_rows" in rows.columns else F.count("*")
    return rows.groupBy(*columns).agg(n.alias("n_rows"))


def by_patient(merged: DataFrame, placed: bool = False) -> DataFrame:
    """Place all rows of a patient together, once, for the patient-wise steps that follow.

    ``placed`` says that they come from tables bucketed by patient and already are.

    Only for rows merged to (patient, day, method, result): neither copies nor test names
    or numbers, which are free text, make a patient larger. Windows and groupings by
    patient_id and anything else need no further shuffle.
    """
    return merged if placed else merged.repartition("patient_id")


Flags = Callable[[dict[str, Column], dict[str, Column]], dict[str, Column]]


def judge_groups(
    rows: DataFrame, keys: Sequence[str], spans: dict[str, str], flags: Flags, **aggregates: Column
) -> DataFrame:
    """One row per group with boolean columns that judge it, and further aggregates.

    ``spans`` names the columns whose group-wide smallest and largest values ``flags``
    receives; they stay as ``min_`` and ``max_`` columns.
    """
    ends = [F.min(column).alias(f"min_{name}") for name, column in spans.items()]
    ends += [F.max(column).alias(f"max_{name}") for name, column in spans.items()]
    wanted = flags({n: F.col(f"min_{n}") for n in spans}, {n: F.col(f"max_{n}") for n in spans})
    groups = rows.groupBy(*keys).agg(*ends, *[a.alias(n) for n, a in aggregates.items()])
    return groups.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in wanted.items()})


def flag_groups(rows: DataFrame, keys: Sequence[str], spans: dict[str, str], flags: Flags) -> DataFrame:
    """Rows with boolean columns that judge their whole group, as in ``judge_groups``.

    Only the flagged groups are joined back.
    """
    judged = judge_groups(rows, keys, spans, flags)
    wanted = [c for c in judged.columns if c not in keys and not c.startswith(("min_", "max_"))]
    flagged = judged.where(any_of(F.col(n) for n in wanted)).select(*keys, *wanted)
    joined = join_groups(rows, flagged, keys, "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in wanted})


def _disagree(low: dict[str, Column], high: dict[str, Column]) -> dict[str, Column]:
    return {"conflicts": low["value"] != high["value"]}


def drop_conflicting_groups(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Drop whole groups in which ``value`` takes two or more non-null values."""
    conflicting = judge_groups(rows, keys, {"value": value}, _disagree).where("conflicts").select(*keys)
    return join_groups(rows, conflicting, keys, "left_anti")


def agreeing_groups(rows: DataFrame, keys: Sequence[str], value: str, **aggregates: Column) -> DataFrame:
    """The groups ``drop_conflicting_groups`` keeps, a row each, with their one value in ``value``."""
    judged = judge_groups(rows, keys, {"value": value}, _disagree, **aggregates).where(~F.col("conflicts"))
    return judged.select(*keys, F.col("min_value").alias(value), *aggregates)


def value_splitters(values: DataFrame, value: str, n: int) -> Column:
    """One value: up to ``n`` distinct values in order, a random sample of those that ``values`` holds.

    Of each of ``n`` hash cells the value with the smallest hash, which combines map-side.
    """
    cell, draw = F.pmod(F.xxhash64(value), F.lit(n)), F.xxhash64(value, F.lit(1))
    drawn = values.where(F.col(value).isNotNull()).groupBy(cell.alias("cell")).agg(F.min_by(value, draw).alias("drawn"))
    return drawn.agg(F.array_sort(F.collect_set("drawn")).alias("splitters")).scalar()


def dense_rank_values(rows: DataFrame, keys: Sequence[str], value: str, rank: str, cells: int = 1) -> DataFrame:
    """Distinct (keys, value) with the value's dense rank in its group, nulls last.

    Copies are merged before the window, so it sorts distinct values only. With ``cells``
    above 1 a group is sorted in about as many ranges of values, each by itself: only the
    ranges' counts of a group meet, and a value's rank is its place in its range after all
    that lie in smaller ones. That is for groups whose distinct values fill a task.
    """
    distinct = rows.select(*keys, value).distinct()
    if cells == 1:
        order = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
        return distinct.withColumn(rank, F.dense_rank().over(order))
    below = F.size(F.filter("splitters", lambda s: s < F.col(value)))
    placed = distinct.withColumn("splitters", value_splitters(distinct, value, cells)).select(
        *keys, value, F.when(F.col(value).isNull(), cells + 1).otherwise(below).alias("rank_cell")
    )
    counts = placed.groupBy(*keys, "rank_cell").agg(F.count("*").alias("cell_rows"))
    before = Window.partitionBy(*keys).orderBy("rank_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("rank_start", F.coalesce(F.sum("cell_rows").over(before), F.lit(0))).drop("cell_rows")
    inside = Window.partitionBy(*keys, "rank_cell").orderBy(F.col(value).asc_nulls_last())
    joined = join_groups(placed, starts, (*keys, "rank_cell"), "inner")
    ranked = joined.withColumn(rank, (F.col("rank_start") + F.row_number().over(inside)).cast("int"))
    return ranked.select(*keys, value, rank)


def keys_in(rows: DataFrame, other: DataFrame, key: str = "patient_id", merged: bool = False) -> DataFrame:
    """``key IN (SELECT key FROM other)``, the list made distinct before the join.

    ``merged`` says that ``rows`` hold few rows per key: then a partitioning by key
    that is already there is used again. Otherwise the rows get a shuffle of their own
    at the join, so that a hot key can be split.
    """
    listed = other.where(F.col(key).isNotNull()).select(key).distinct()
    return rows.join(listed, key, "left_semi") if merged else join_groups(rows, listed, [key], "left_semi")


def keys_not_in(
    rows: DataFrame, other: DataFrame, key: str = "patient_id", merged: bool = False, null_aware: bool = False
) -> DataFrame:
    """``key NOT IN (SELECT key FROM other)``; ``merged`` as in ``keys_in``.

    Tables are loaded without null keys, so a plain anti join is exact and needs no
    broadcast. ``null_aware=True`` adds the SQL rule for lists that hold a null
    (nothing qualifies) and for rows whose own key is null (they qualify only
    against an empty list), as a one-row subquery beside the same anti join.
    """
    listed = other.select(key)
    found = listed.where(F.col(key).isNotNull()).distinct()
    kept = rows.join(found, key, "left_anti") if merged else join_groups(rows, found, [key], "left_anti")
    if not null_aware:
        return kept
    facts = listed.agg(
        F.coalesce(F.max(F.col(key).isNull()), F.lit(False)).alias("has_null"), F.count("*").alias("n")
    )
    has_null, empty = facts.select("has_null").scalar(), facts.select(F.col("n") == 0).scalar()
    return kept.where(~has_null & (F.col(key).isNotNull() | empty))


MAP_BITS = 32768  # of one bitmap as bitmap_construct_agg makes it
COHORT_BITS = 1 << 23


def _slot(key: Column, n_bits: int) -> Column:
    """A place for a key; as text, so that a whole number has the same one whatever its width."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(n_bits))


def cohort_bits(cohort: DataFrame, key: str = "patient_id", n_bits: int = COHORT_BITS) -> Column:
    """One value: an array of ``n_bits`` / 64 longs, in which every key of ``cohort`` has set a bit.

    Its size does not depend on the cohort, so any plan may carry it: 1 MB by default, which
    still tells keys apart in a cohort of some 5 million.
    Bitmaps are or-ed map-side; one task puts at most ``n_bits`` / 32768 of them in order.
    """
    slots = cohort.where(F.col(key).isNotNull()).select((_slot(F.col(key), n_bits) + 1).alias("slot"))
    maps = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    words = MAP_BITS // 64

    def word(maps: Column, i: Column) -> Column:
        bits = F.element_at(maps, F.floor(i / words) + 1)
        eight = F.substring(bits, (i % words * 8 + 1).cast("int"), F.lit(8))
        return F.coalesce(F.conv(F.hex(eight), 16, -10).cast("bigint"), F.lit(0).cast("bigint"))

    one = maps.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bits"))).alias("maps"))
    numbers = F.sequence(F.lit(0), F.lit(n_bits // 64 - 1))
    return one.select(F.transform(numbers, lambda i: word(F.col("maps"), i)).alias("bits")).scalar()


def may_hold(bits: Column, key: str = "patient_id", n_bits: int = COHORT_BITS) -> Column:
    """Whether ``cohort_bits`` has the key's bit: true for every key of the cohort and for a few others.

    A plain condition on the rows, so Spark tests it where it scans them, below every
    exchange. The larger the cohort beside ``n_bits``, the more rows pass for nothing; the
    join that is exact comes later and on what is left.
    """
    slot = _slot(F.col(key), n_bits)
    place = slot % 64  # bit 0 of byte 0 comes first, and byte 0 is the highest of its long
    shift = ((7 - F.floor(place / 8)) * 8 + place % 8).cast("int")
    return F.call_function("shiftright", F.get(bits, F.floor(slot / 64).cast("int")), shift) % 2 != 0


def join_per_patient(rows: DataFrame, cohort: DataFrame) -> DataFrame:
    """Inner join of many rows per patient with a cohort of few, split where a patient is hot."""
    return join_groups(rows, cohort.where(F.col("patient_id").isNotNull()), ["patient_id"], "inner")


def left_join_many(cohort: DataFrame, rows: DataFrame) -> DataFrame:
    """``cohort LEFT JOIN rows USING (patient_id)`` with a splittable many side.

    An outer join can only be split on the side it preserves, here the wrong one. So the
    matches come from an inner join and the patients without any are added.
    """
    matched = join_per_patient(rows, cohort)
    alone = keys_not_in(cohort, rows)
    return matched.unionByName(alone, allowMissingColumns=True).select(
        *cohort.columns, *[c for c in rows.columns if c != "patient_id"]
    )


def count_patients(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: distinct patients meeting each condition.

    One pass: a flag per condition and patient, then a sum. Several
    count(distinct ...) side by side would copy every row once per count.
    """
    flags = [F.max(F.when(cond, 1).otherwise(0)).alias(name) for name, cond in conditions.items()]
    per_patient = df.where(F.col("patient_id").isNotNull()).groupBy("patient_id").agg(*flags)
    return per_patient.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in conditions])


def repeat_rows(df: DataFrame, count: str = "n_rows") -> DataFrame:
    """Rows written out as often as ``count`` says, without the count.

    The count is read as digits to base 1024 and each digit is fanned out in steps
    of at most 1024, so no row ever holds an array as long as its count.
    """
    digits = F.array(
        *[
            F.struct(
                F.shiftright(F.col(count).cast("bigint"), 10 * power).bitwiseAND(1023).cast("int").alias("digit"),
                F.lit(power).alias("power"),
            )
            for power in range(6)
        ]
    )
    out = df.withColumn("part", F.explode(digits)).where(F.col("part.digit") > 0)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("part.digit"))))
    for power in range(1, 6):
        fan = F.when(F.col("part.power") >= power, F.lit(1024)).otherwise(F.lit(1))
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), fan)))
    return out.drop(count, "part", "copy")
