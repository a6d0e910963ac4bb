"""Test selection and the month-band cohort filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oncolens.functions import vocab
from oncolens.functions.columns import all_of, month_number, one_of
from oncolens.functions.patterns import similar_to


def her2_rule(methods: str = vocab.METHODS_CONTAINS) -> Column:
    """HER2 tests by code, by code and method, or by code and score."""
    code = F.col("test_name_code")
    assay = similar_to(F.lower("test_method_name"), methods)
    amplification = similar_to(F.lower("genetic_test_type_name"), vocab.AMPLIFICATION_TEST_TYPES)
    scored = one_of("test_value_numeric", vocab.HER2_STATUS_SCORES)
    by_method = assay & (
        (code == vocab.HER2_GENE_CODE) | amplification | F.col("genetic_test_type_name").isNull()
    )
    qualified = (
        one_of("test_name_code", vocab.HER2_CODES)
        | (one_of("test_name_code", (vocab.HER2_GENE_CODE, vocab.HER2_AMPLIFICATION_CODE)) & by_method)
        | ((code == vocab.HER2_STATUS_CODE) & (scored | F.col("test_value_numeric").isNull()))
    )
    # Implied by the rule above, but in a form the parquet reader can skip row groups by.
    coded = one_of(
        "test_name_code",
        (*vocab.HER2_CODES, vocab.HER2_GENE_CODE, vocab.HER2_AMPLIFICATION_CODE, vocab.HER2_STATUS_CODE),
    )
    return coded & qualified


def her2_test_filter(patient_test: DataFrame, methods: str = vocab.METHODS_CONTAINS) -> DataFrame:
    return patient_test.where(her2_rule(methods))


def receptor_rules(method_pattern: str, panel_pattern: str) -> dict[str, Column]:
    """ER, PR and combined-panel conditions for one reading of the method column."""
    code, method = F.col("test_name_code"), F.col("test_method_name")
    stained = method.ilike(method_pattern)
    return {
        "ER": one_of("test_name_code", vocab.ER_CODES) | ((code == vocab.ER_GENE_CODE) & stained),
        "PR": one_of("test_name_code", vocab.PR_CODES) | ((code == vocab.PR_GENE_CODE) & stained),
        "ER/PR": F.col("test_name_name").ilike(vocab.HORMONE_PANEL) & method.ilike(panel_pattern),
    }


def receptor_diagnoses(condition: DataFrame) -> DataFrame:
    return condition.where(F.col("diagnosis_code_code").ilike(vocab.RECEPTOR_DIAGNOSIS))


def er_pr_rule() -> Column:
    """Receptor tests; only the ER rule asks for a date, and a missing one fails any band later anyway."""
    rules = receptor_rules("%immunohisto%", "immuno%")
    return (F.col("test_date").isNotNull() & rules["ER"]) | rules["PR"] | rules["ER/PR"]


def er_pr_tests(patient_test: DataFrame, condition: DataFrame) -> DataFrame:
    """Distinct patient and date of receptor tests and receptor diagnoses."""
    tests = patient_test.where(er_pr_rule()).select("patient_id", "test_date")
    diagnoses = receptor_diagnoses(condition).select("patient_id", F.col("diagnosis_date").alias("test_date"))
    return tests.union(diagnoses).distinct()


BITS = 64  # months in one bitmap


def _era_months(lo: int, hi: int) -> int:
    """Months from the start of one bitmap to the next, so that any band lies in the bitmap of its first month."""
    width = hi - lo + 1
    if not 0 < width <= BITS:
        raise ValueError(f"a band of {width} months; 1 to {BITS} fit one bitmap")
    return BITS + 1 - width


def month_bits(tests: DataFrame, kinds: Sequence[str], lo: int = -12, hi: int = 1) -> DataFrame:
    """patient_id, era and for each kind a bitmap of tested months, for bands from ``lo`` to ``hi``.

    ``tests`` has patient_id, test_date and a boolean column per kind. Bitmaps of 64 months
    overlap by a band's width less one, so a month is in one of them or two. They are or-ed
    map-side: a much-tested patient brings a row per era, whatever the kinds and days.
    """
    step, month = _era_months(lo, hi), month_number(F.col("test_date"))
    eras = F.sequence(F.floor((month - BITS) / step) + 1, F.floor(month / step))
    placed = tests.where(F.col("test_date").isNotNull()).select(
        "patient_id", month.alias("month"), F.explode(eras).alias("era"), *kinds
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("month") - F.col("era") * step).cast("int"))
    return placed.groupBy("patient_id", "era").agg(
        *[F.bit_or(F.when(F.col(k), bit).otherwise(F.lit(0).cast("bigint"))).alias(k) for k in kinds]
    )


def flag_tested(cohort: DataFrame, months: DataFrame, kinds: Sequence[str], lo: int = -12, hi: int = 1) -> DataFrame:
    """Cohort rows with a boolean per kind: a test ``lo`` to ``hi`` month boundaries from onset.

    One equality join: the band of a row is a mask in the bitmap that holds its first month.
    """
    step, first = _era_months(lo, hi), month_number(F.col("met_date")) + lo
    width = hi - lo + 1
    ones = -1 if width == BITS else (1 << width) - 1
    era = F.floor(first / step)
    mask = F.call_function("shiftleft", F.lit(ones).cast("bigint"), (first - era * step).cast("int"))
    tested = months.select(
        F.col("patient_id").alias("tested_patient"), F.col("era").alias("tested_era"), *[F.col(k).alias(f"{k}_bits") for k in kinds]
    )
    same = (F.col("patient_id") == F.col("tested_patient")) & (era == F.col("tested_era"))
    hits = {k: F.coalesce(F.col(f"{k}_bits").bitwiseAND(mask) != 0, F.lit(False)) for k in kinds}
    found = cohort.join(tested, same, "left").withColumns(hits)
    return found.select(*cohort.columns, *kinds)


def _in_band(cohort: DataFrame, tests: DataFrame, kinds: Sequence[str], lo: int, hi: int) -> DataFrame:
    flagged = flag_tested(cohort, month_bits(tests, kinds, lo, hi), kinds, lo, hi)
    return flagged.where(all_of(F.col(k) for k in kinds)).select("patient_id", "met_date").distinct()


def with_test_in_window(cohort: DataFrame, tests: DataFrame, lo: int = -12, hi: int = 1) -> DataFrame:
    """Cohort rows with at least one test ``lo`` to ``hi`` month boundaries from onset; days do not matter."""
    return _in_band(cohort, tests.select("patient_id", "test_date", F.lit(True).alias("tested")), ("tested",), lo, hi)


KINDS = ("her2", "er_pr")


def with_both_tests_in_window(
    cohort: DataFrame, her2: DataFrame, er_pr: DataFrame, lo: int = -12, hi: int = 1
) -> DataFrame:
    """Cohort rows with a test of either kind in the band."""
    yes, no = F.lit(True), F.lit(False)
    tests = her2.select("patient_id", "test_date", yes.alias("her2"), no.alias("er_pr")).union(
        er_pr.select("patient_id", "test_date", no, yes)
    )
    return _in_band(cohort, tests, KINDS, lo, hi)


def tests_by_kind(patient_test: DataFrame, condition: DataFrame) -> DataFrame:
    """patient_id, test_date, her2, er_pr: both kinds from one read of the tests, and the receptor diagnoses."""
    rules = {"her2": her2_rule(vocab.METHODS_PREFIX), "er_pr": er_pr_rule()}
    tests = patient_test.where(rules["her2"] | rules["er_pr"]).select(
        "patient_id", "test_date", *[F.coalesce(rule, F.lit(False)).alias(k) for k, rule in rules.items()]
    )
    return tests.union(
        receptor_diagnoses(condition).select("patient_id", F.col("diagnosis_date"), F.lit(False), F.lit(True))
    )


def with_kinds_in_window(cohort: DataFrame, tests: DataFrame, lo: int = -12, hi: int = 1) -> DataFrame:
    """``with_both_tests_in_window`` on ``tests_by_kind``."""
    return _in_band(cohort, tests, KINDS, lo, hi)
