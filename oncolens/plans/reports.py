"""Report conditions and listings over the pipeline stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oncolens.functions import vocab
from oncolens.functions.columns import one_of
from oncolens.functions.patterns import similar_to
from oncolens.operators.grouping import count_patients, keys_in, keys_not_in, repeat_rows

STAINED = ("IHC", "FISH")


# --- conditions on the wide table -----------------------------------------
def _fish_negative(or_missing: bool) -> Column:
    negative = F.col("her2_fish") == "Negative"
    return negative | F.col("her2_fish").isNull() if or_missing else negative


def her2_low(labels: Sequence[str], or_missing: bool) -> Column:
    """IHC result among ``labels`` with a negative FISH, or optionally none.

    The labels belong to a ruleset: the current rules write Low1+ and Low2+ instead.
    """
    return one_of("her2_ihc", labels) & _fish_negative(or_missing)


def her2_negative() -> Column:
    return (F.col("her2_ihc") == "Negative") | (F.col("her2_ihc").isNull() & _fish_negative(False))


def strict_her2_negative() -> Column:
    return ((F.col("her2_ihc") == "Negative") & _fish_negative(True)) | (
        F.col("her2_ihc").isNull() & _fish_negative(False)
    )


def any_her2() -> Column:
    return F.col("her2_ihc").isNotNull() | F.col("her2_fish").isNotNull()


def hr(status: str) -> Column:
    return F.col("hr_status") == status


def receptor_conditions(
    borderline: Sequence[str] = ("Borderline",), low: Sequence[str] = ("Borderline", "Low")
) -> dict[str, Column]:
    """The ten counted groups: four HER2-low definitions and HER2-negative, by HR status."""
    groups = {
        "borderline_fish_negative": her2_low(borderline, False),
        "borderline_fish_negative_or_missing": her2_low(borderline, True),
        "low_fish_negative": her2_low(low, False),
        "low_fish_negative_or_missing": her2_low(low, True),
    }
    out = {f"hr_pos_{name}": hr("Positive") & group for name, group in groups.items()}
    out |= {f"hr_neg_{name}": hr("Negative") & group for name, group in groups.items()}
    out["hr_pos_her2_negative"] = hr("Positive") & her2_negative()
    out["triple_negative"] = hr("Negative") & her2_negative()
    return out


def receptor_report(wide: DataFrame, **labels: Sequence[str]) -> DataFrame:
    """All ten counts in one pass."""
    return count_patients(wide, **receptor_conditions(**labels))


# --- labelled tests -------------------------------------------------------
def stained_negative() -> Column:
    return one_of("test_method", STAINED) & (F.col("test_result") == "Negative")


def flagged() -> Column:
    return F.col("sameday_ind") != "none"


def labelled_counts(labelled: DataFrame) -> DataFrame:
    return count_patients(
        labelled,
        negative=stained_negative(),
        negative_flagged=stained_negative() & flagged(),
        ihc_negative=(F.col("test_method") == "IHC") & (F.col("test_result") == "Negative"),
    )


def conflict_rows(labelled: DataFrame, merged: DataFrame) -> DataFrame:
    """Flagged stained rows of patients who have a flagged negative, found in the merged labels."""
    return keys_in(
        labelled.where(one_of("test_method", STAINED) & flagged()),
        merged.where((F.col("test_result") == "Negative") & flagged()),
    )


def ruleset_diff(rows: DataFrame, others: DataFrame, merged: bool = False) -> DataFrame:
    """Rows whose patient does not occur among ``others``."""
    return keys_not_in(rows, others, merged=merged)


def ruleset_diff_side_by_side(both: DataFrame, left: str, right: str, rows: Column, others: Column) -> DataFrame:
    """``ruleset_diff`` where one table holds both rulesets; its rows lie placed by patient already."""
    elsewhere = F.max(F.when((F.col("ruleset") == right) & others, 1)).over(Window.partitionBy("patient_id"))
    kept = both.withColumn("elsewhere", elsewhere).where((F.col("ruleset") == left) & rows & F.col("elsewhere").isNull())
    return kept.drop("elsewhere", "ruleset")


def her2_result(result: str) -> Column:
    return (F.col("biomarker") == "HER2") & (F.col("test_result") == result)


# --- listings -------------------------------------------------------------
def sorted_by(df: DataFrame, *columns: str) -> DataFrame:
    """Sorted by ``columns``, ties by all other columns, so that the order is the same each time.

    The sort is by value ranges, which the other columns let cut a hot value. Equal rows
    are merged first and written out again after the sort, as a pile of them cannot be cut.
    """
    rest = [c for c in df.columns if c not in columns]
    merged = df.groupBy(*df.columns).agg(F.count("*").alias("sorted_copies"))
    ordered = merged.orderBy(*[F.col(c).asc_nulls_last() for c in [*columns, *rest]])
    return repeat_rows(ordered, "sorted_copies").select(*df.columns)


def preview(df: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` rows in full column order, so that a preview is repeatable."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in df.columns]).limit(n)


# --- genetic and clinical look-ups ----------------------------------------
def erbb2(genetic_test: DataFrame, *test_types: str) -> DataFrame:
    rows = genetic_test.where(F.col("biomarker_name") == "ERBB2")
    return rows.where(one_of("biomarker_test_type", test_types)) if test_types else rows


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def patients_by(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct patients per group; patients are merged per group before the count."""
    return df.groupBy(*columns).agg(F.count_distinct("patient_id").alias("n"))


def scored_genetic(genetic_test: DataFrame) -> DataFrame:
    return genetic_test.where(one_of("test_result_1_numeric", vocab.GENETIC_SCORES))


def named_her2(patient_test: DataFrame) -> DataFrame:
    """Tests whose name holds ERBB2 or HER2, as written."""
    return patient_test.where(similar_to(F.col("test_name_name"), vocab.HER2_NAMES))
