"""The three analyses end to end, as plain compositions of the operators.

``load(name)`` returns an input table; the plans do not know where it lives.
``source`` picks one of the receptor variants: the revised or the current result
rules on clinical tests, or the revised rules with genetic tests added.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oncolens.functions import vocab
from oncolens.operators import her2, onset, ras, receptor, windowed
from oncolens.operators.grouping import by_patient, cohort_bits, count_patients, may_hold
from oncolens.sources.tables import scanned_bytes

Load = Callable[[str], DataFrame]
SOURCES = ("revised", "current", "genetic")
RULESETS = ("revised", "current")
#: Tables with many rows per patient, of which a cohort needs its own patients' only.
TEST_TABLES = ("patient_test", "genetic_test", "condition")
#: From where a table is worth the cohort's bitmap, which costs a small job: where Spark begins with its own such filters.
CUT_ABOVE = 10 << 30
RANK_CELLS = 64


class placed:
    """``load`` of tables that are bucketed by patient alike (``tables.write_bucketed``).

    Patient-wise plans on one table then work bucket by bucket and exchange nothing. A
    bucket can't be split, so this is for data in which no patient fills one.
    """

    def __init__(self, load: Load):
        self.load = load

    def __call__(self, name: str) -> DataFrame:
        return self.load(name)


def for_metastatic(load: Load, cut_above: int = CUT_ABOVE) -> Load:
    """``load`` with the test tables cut, where they are scanned, to patients with a sign of metastasis, and a few others.

    For steps that work patient by patient and end in a join with the metastatic cohort:
    the join stays exact, and what precedes it no longer judges, shuffles and matches
    everybody. The signs are taken as they are scanned, which spares an exchange. Tables of
    less than ``cut_above`` bytes are left as they are.
    """

    @cache
    def bits() -> Column:
        return cohort_bits(onset.metastatic_signs(load("stage"), load("condition")))

    @cache
    def cut(name: str) -> DataFrame:
        df = load(name)
        return df.where(may_hold(bits())) if name in TEST_TABLES and scanned_bytes(df) >= cut_above else df

    return placed(cut) if isinstance(load, placed) else cut


# --- metastatic cohort ----------------------------------------------------
def metastatic_onset(load: Load) -> DataFrame:
    return onset.metastatic_onset(load("stage"), load("condition"))


def antineoplastic_codes(load: Load, cohort: str = "breast") -> DataFrame:
    return onset.antineoplastic_codes(
        load("drug"), load("drug_rxnorm_map"), load("drug_condition"), load("drug_cohort"), cohort
    )


def systemic_therapy(load: Load) -> DataFrame:
    return onset.systemic_therapy(load("medication"), antineoplastic_codes(load))


def metastatic_on_therapy(load: Load) -> DataFrame:
    return onset.metastatic_on_therapy(metastatic_onset(load), systemic_therapy(load))


def onset_in_years(load: Load, first: int, last: int) -> DataFrame:
    return onset.onset_year_between(metastatic_on_therapy(load), first, last)


def no_second_primary(load: Load, first: int, last: int) -> DataFrame:
    return onset.exclude_second_primary(onset_in_years(load, first, last), load("condition"))


def her2_tests(load: Load) -> DataFrame:
    return windowed.her2_test_filter(load("patient_test"), vocab.METHODS_PREFIX)


def her2_in_window(load: Load, first: int, last: int) -> DataFrame:
    return windowed.with_test_in_window(no_second_primary(load, first, last), her2_tests(load))


def er_pr_tests(load: Load) -> DataFrame:
    return windowed.er_pr_tests(load("patient_test"), load("condition"))


def tests_by_kind(load: Load) -> DataFrame:
    return windowed.tests_by_kind(load("patient_test"), load("condition"))


def both_in_window(load: Load, first: int, last: int) -> DataFrame:
    return windowed.with_kinds_in_window(no_second_primary(load, first, last), tests_by_kind(load))


def funnel(load: Load, first: int, last: int) -> DataFrame:
    """One row: the patients left after each step from therapy to both tests, in one pass.

    Each step is a flag on the treated patients rather than a cohort of its own; a
    patient's onset is one row, so flags are counted as they stand.
    """
    treated = metastatic_on_therapy(load)
    flagged = onset.flag_second_primary(treated, load("condition"))
    flagged = windowed.flag_tested(flagged, windowed.month_bits(tests_by_kind(load), windowed.KINDS), windowed.KINDS)
    in_years = onset.in_years(first, last)
    alone = in_years & ~F.col("second_primary")
    return count_patients(
        flagged,
        n_on_therapy=F.lit(True),
        n_onset_in_years=in_years,
        n_no_second_primary=alone,
        n_her2_in_window=alone & F.col("her2"),
        n_both_in_window=alone & F.col("her2") & F.col("er_pr"),
    )


# --- receptor status ------------------------------------------------------
def labelled(load: Load, source: str = "revised") -> DataFrame:
    """HER2 tests row by row, with their labels."""
    if source == "genetic":
        return her2.her2_label_with_genetic(load("patient_test"), load("genetic_test"))
    return her2.her2_label(load("patient_test"), source)


def labelled_merged(load: Load, source: str = "revised") -> DataFrame:
    """The same labels on merged tests, for everything that does not list tests."""
    if source == "genetic":
        tests = her2.her2_tests_with_genetic(load("patient_test"), load("genetic_test"))
        return her2.label_merged(tests, "revised", vocab.IHC_PATTERN_GENETIC)
    return her2.label_merged(windowed.her2_test_filter(load("patient_test")), source)


def nearest_fish(load: Load, source: str = "revised") -> DataFrame:
    if source == "genetic":
        tests = her2.her2_tests_with_genetic(load("patient_test"), load("genetic_test"))
        settled = her2.settled_tests(tests, "revised", vocab.IHC_PATTERN_GENETIC)
    else:
        settled = her2.settled_tests(windowed.her2_test_filter(load("patient_test")), source)
    return her2.match_settled(settled, placed=isinstance(load, placed))


def er_pr_labelled(load: Load, source: str = "revised", columns: Sequence[str] | None = None) -> DataFrame:
    narrowed = {"columns": columns} if columns else {}
    if source == "genetic":
        return receptor.er_pr_label_with_genetic(
            load("patient_test"), load("genetic_test"), load("condition"), **narrowed
        )
    return receptor.er_pr_label(load("patient_test"), load("condition"), **narrowed)


def receptor_tests(load: Load, source: str = "revised") -> DataFrame:
    settled = receptor.settled_receptors(er_pr_labelled(load, source, receptor.CONFLICT_COLUMNS))
    return receptor.receptor_tests(by_patient(settled, isinstance(load, placed)), nearest_fish(load, source))


def her2_results(load: Load, source: str = "revised") -> DataFrame:
    """The HER2 rows of ``receptor_tests``, without the work on ER and PR."""
    return receptor.her2_results(nearest_fish(load, source)).distinct()


def nearest_to_onset(load: Load, source: str = "revised", cut_above: int = CUT_ABOVE) -> DataFrame:
    tests = receptor_tests(for_metastatic(load, cut_above), source)
    return receptor.nearest_test_to_onset(tests, metastatic_onset(load))


def receptor_status(load: Load, source: str = "revised", cut_above: int = CUT_ABOVE) -> DataFrame:
    return receptor.receptor_wide(nearest_to_onset(load, source, cut_above))


# The revised and the current rules side by side: one read of the tests, ``ruleset`` in front of each row.
def nearest_fish_by_ruleset(load: Load) -> DataFrame:
    settled = her2.settled_by_ruleset(windowed.her2_test_filter(load("patient_test")), RULESETS)
    return her2.match_settled(settled, by=("ruleset",), placed=isinstance(load, placed))


def her2_results_by_ruleset(load: Load) -> DataFrame:
    return receptor.her2_results(nearest_fish_by_ruleset(load), by=("ruleset",)).distinct()


def receptor_status_by_ruleset(load: Load, cut_above: int = CUT_ABOVE) -> DataFrame:
    cut = for_metastatic(load, cut_above)
    settled = receptor.settled_receptors(er_pr_labelled(cut, columns=receptor.CONFLICT_COLUMNS))
    er_pr = by_patient(settled, isinstance(load, placed)).withColumn("ruleset", F.explode(F.array(*map(F.lit, RULESETS))))
    tests = receptor.receptor_tests(er_pr, nearest_fish_by_ruleset(cut), by=("ruleset",))
    return receptor.receptor_wide(receptor.nearest_test_to_onset(tests, metastatic_onset(load), by=("ruleset",)), by=("ruleset",))


# --- RAS ------------------------------------------------------------------
def _with_rank_cells(load: Load, ranks: Callable[..., DataFrame]) -> DataFrame:
    """``ranks`` of the biomarker table, variants of one patient ranked in ranges where the table is large."""
    biomarker = load("biomarker_table")
    return ranks(biomarker, cells=RANK_CELLS if scanned_bytes(biomarker) >= CUT_ABOVE else 1)


def ras_mutations(load: Load) -> DataFrame:
    return _with_rank_cells(load, ras.ras_mutations)


def ras_correct_counts(load: Load) -> DataFrame:
    return ras.ras_correct_counts(_with_rank_cells(load, ras.ras_variant_ranks))


def ras_secondary_percent(load: Load) -> DataFrame:
    return ras.ras_secondary_percent(_with_rank_cells(load, ras.ras_variant_ranks))
