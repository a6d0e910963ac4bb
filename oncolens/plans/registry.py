"""Every runnable query by name: composites, reports and single operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oncolens.functions import vocab
from oncolens.functions.columns import one_of
from oncolens.operators import her2, ras, receptor, windowed
from oncolens.operators.grouping import count_patients
from oncolens.plans import pipelines, reports
from oncolens.plans.pipelines import Load
from oncolens.plans.primitives import PRIMITIVES, side_tables
from oncolens.sources.fixtures import delivered, view
from oncolens.sources.tables import conform, store_stage

# The fixture dates run from 1995 to 2001.
YEARS = (1996, 1999)
SINCE = "1998-01-01"


def plain(df: DataFrame) -> DataFrame:
    """Integers as bigint and dates as ISO text, so any two engines compare alike."""
    out = []
    for name, kind in df.dtypes:
        column = F.col(name)
        if kind in ("int", "smallint", "tinyint"):
            column = column.cast("bigint").alias(name)
        elif kind == "date":
            column = column.cast("string").alias(name)
        out.append(column)
    return df.select(*out)


def _her2_steps(load: Load, last: str, ruleset: str = "revised") -> DataFrame:
    """The labelling chain stopped after one step, on the selected HER2 tests."""
    df = windowed.her2_test_filter(load("patient_test")).select(*her2.CLINICAL_COLUMNS)
    steps = {
        "method": her2.label_method,
        "result": lambda d: her2.clean_result(d, ruleset),
        "numeric": her2.clean_numeric,
        "same_day": lambda d: her2.same_day_indicator(d, ruleset),
        "change": lambda d: her2.apply_change(d, ruleset),
    }
    for name, step in steps.items():
        df = step(df)
        if name == last:
            return df
    raise KeyError(last)


def _table(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[Load], DataFrame]:
    return lambda load: operator(load(name))


COMPOSITES: dict[str, Callable[[Load], DataFrame]] = {
    "metastatic_onset": pipelines.metastatic_onset,
    "antineoplastic_codes": pipelines.antineoplastic_codes,
    "systemic_therapy": pipelines.systemic_therapy,
    "metastatic_on_therapy": pipelines.metastatic_on_therapy,
    "onset_year_between": lambda load: pipelines.onset_in_years(load, *YEARS),
    "exclude_second_primary": lambda load: pipelines.no_second_primary(load, *YEARS),
    "her2_test_filter": _table("patient_test", windowed.her2_test_filter),
    "her2_test_filter_prefix": pipelines.her2_tests,
    "with_test_in_window": lambda load: pipelines.her2_in_window(load, *YEARS),
    "er_pr_tests": pipelines.er_pr_tests,
    "with_both_tests_in_window": lambda load: pipelines.both_in_window(load, *YEARS),
    "her2_label": pipelines.labelled,
    "her2_label_current": lambda load: pipelines.labelled(load, "current"),
    "label_method": lambda load: _her2_steps(load, "method"),
    "clean_result": lambda load: _her2_steps(load, "result"),
    "clean_result_current": lambda load: _her2_steps(load, "result", "current"),
    "clean_numeric": lambda load: _her2_steps(load, "numeric"),
    "same_day_indicator": lambda load: _her2_steps(load, "same_day"),
    "same_day_indicator_current": lambda load: _her2_steps(load, "same_day", "current"),
    "apply_change": lambda load: _her2_steps(load, "change"),
    "apply_change_current": lambda load: _her2_steps(load, "change", "current"),
    "her2_label_with_genetic": lambda load: pipelines.labelled(load, "genetic"),
    "er_pr_label": pipelines.er_pr_labelled,
    "er_pr_label_with_genetic": lambda load: pipelines.er_pr_labelled(load, "genetic"),
    "er_pr_label_with_genetic_fixed": lambda load: receptor.er_pr_label_with_genetic(
        load("patient_test"), load("genetic_test"), load("condition"), fix_ihc_label=True
    ),
    "drop_same_day_conflicts": lambda load: receptor.drop_same_day_conflicts(pipelines.er_pr_labelled(load)),
    "drop_same_day_conflicts_genetic": lambda load: receptor.drop_same_day_conflicts(
        pipelines.er_pr_labelled(load, "genetic")
    ),
    "nearest_fish_for_ihc_in_days": lambda load: her2.nearest_fish_for_ihc(
        pipelines.labelled(load), window_days=(-5, 30)
    ),
    "enrich_cohort": lambda load: receptor.enrich_cohort(
        pipelines.metastatic_on_therapy(load), *side_tables(load), since=SINCE
    ),
    "normalise_variant": lambda load: ras.with_variant(load("biomarker_table")).select(
        "patient_id", "molecular_variant", "biomarker_variant_type_name", "variant"
    ),
    "ras_mutations": pipelines.ras_mutations,
    "ras_mutations_in_ranges": lambda load: ras.ras_mutations(load("biomarker_table"), cells=8),
    "ras_correct_counts": pipelines.ras_correct_counts,
    "ras_secondary_percent": pipelines.ras_secondary_percent,
    "kras_coamplified_by_variant": _table("biomarker_table", ras.kras_coamplified_by_variant),
    "kras_coamplified_percent": _table("biomarker_table", ras.kras_coamplified_percent),
    "kras_wt_amp_by_variant": _table("biomarker_table", ras.kras_wt_amp_by_variant),
    "kras_wt_amp_percent": _table("biomarker_table", ras.kras_wt_amp_percent),
}
# With the test tables cut to the cohort, as large ones are.
COMPOSITES["receptor_wide_genetic_cut"] = partial(pipelines.receptor_status, source="genetic", cut_above=0)
for _source in pipelines.SOURCES:
    _suffix = "" if _source == "revised" else f"_{_source}"
    COMPOSITES |= {
        f"nearest_fish_for_ihc{_suffix}": partial(pipelines.nearest_fish, source=_source),
        f"receptor_tests{_suffix}": partial(pipelines.receptor_tests, source=_source),
        f"nearest_test_to_onset{_suffix}": partial(pipelines.nearest_to_onset, source=_source),
        f"receptor_wide{_suffix}": partial(pipelines.receptor_status, source=_source),
    }


# --- reports --------------------------------------------------------------
def _n(stage: Callable[[Load], DataFrame], condition: Callable[[], Column] | None = None) -> Callable[[Load], DataFrame]:
    """Distinct patients of a stage, or of its rows meeting ``condition()``."""
    return lambda load: _count(condition)(stage(load))


def _count(condition: Callable[[], Column] | None = None) -> Callable[[DataFrame], DataFrame]:
    return lambda df: count_patients(df, n=F.lit(True) if condition is None else condition())


def _hr_positive_strict():
    return reports.hr("Positive") & reports.strict_her2_negative()


def _ihc_negative():
    return F.col("ihc_test_result") == "Negative"


def _her2_negative_rows():
    return reports.her2_result("Negative")


def _diff(stage, left: str, right: str, condition) -> Callable[[Load], DataFrame]:
    return lambda load: reports.ruleset_diff_side_by_side(stage(load), left, right, condition(), condition())


def _negative_counts(load: Load) -> DataFrame:
    """The four counts of HER2-negative patients, both rulesets, from one pass."""
    nearest, found = pipelines.nearest_fish_by_ruleset(load), {}
    for ruleset in pipelines.RULESETS:
        own = F.col("ruleset") == ruleset
        found[f"nearest_{ruleset}"] = own & _ihc_negative()
        found[f"combined_{ruleset}"] = own & (_ihc_negative() | (F.col("fish_test_result") == "Negative"))
    return count_patients(nearest, **found)


def _any_stained():
    return one_of("test_method", reports.STAINED)


REPORTS: dict[str, Callable[[Load], DataFrame]] = {
    "n_on_therapy": _n(pipelines.metastatic_on_therapy),
    "n_onset_in_years": _n(lambda load: pipelines.onset_in_years(load, *YEARS)),
    "n_no_second_primary": _n(lambda load: pipelines.no_second_primary(load, *YEARS)),
    "n_her2_in_window": _n(lambda load: pipelines.her2_in_window(load, *YEARS)),
    "n_both_in_window": _n(lambda load: pipelines.both_in_window(load, *YEARS)),
    "funnel_counts": lambda load: pipelines.funnel(load, *YEARS),
    "q_h13_labelled_genetic": _n(partial(pipelines.labelled_merged, source="genetic")),
    "q_h14_labelled_counts": lambda load: reports.labelled_counts(pipelines.labelled_merged(load)),
    "q_h14_labelled_counts_current": lambda load: reports.labelled_counts(pipelines.labelled_merged(load, "current")),
    "q_h15_conflict_rows": lambda load: reports.sorted_by(
        reports.conflict_rows(pipelines.labelled(load), pipelines.labelled_merged(load)), "patient_id", "test_date"
    ),
    "q_h16_nearest_negative": _n(pipelines.nearest_fish, _ihc_negative),
    "q_h16_nearest_negative_current": _n(partial(pipelines.nearest_fish, source="current"), _ihc_negative),
    "q_h16_combined_negative": _n(pipelines.her2_results, _her2_negative_rows),
    "q_h16_combined_negative_current": _n(partial(pipelines.her2_results, source="current"), _her2_negative_rows),
    "q_h17_labelled": lambda load: reports.sorted_by(
        reports.ruleset_diff(
            pipelines.labelled(load).where(_any_stained()),
            pipelines.labelled_merged(load, "current").where(reports.stained_negative()),
        ),
        "patient_id",
        "test_date",
    ),
    "q_h16_negative_counts": _negative_counts,
    "q_h17_nearest": _diff(pipelines.nearest_fish_by_ruleset, "revised", "current", _ihc_negative),
    "q_h17_combined": _diff(pipelines.her2_results_by_ruleset, "revised", "current", _her2_negative_rows),
    "q_h17_wide": _diff(pipelines.receptor_status_by_ruleset, "current", "revised", _hr_positive_strict),
    "q_h18_negative_tests": lambda load: reports.sorted_by(
        pipelines.labelled(load).where(reports.stained_negative()), "patient_id"
    ),
    "q_h18_negative_tests_current": lambda load: reports.sorted_by(
        pipelines.labelled(load, "current").where(reports.stained_negative()), "patient_id"
    ),
    "q_h18_combined_preview": lambda load: reports.preview(pipelines.receptor_tests(load)),
    "q_h18_nearest_sorted": lambda load: reports.sorted_by(pipelines.nearest_to_onset(load), "datediffer"),
    "q_g1_preview": lambda load: reports.preview(load("genetic_test")),
    "q_g1_erbb2_preview": lambda load: reports.preview(reports.erbb2(load("genetic_test"))),
    "q_g2_patients_by_type": lambda load: reports.patients_by(load("genetic_test"), "biomarker_test_type"),
    "q_g2_icc_by_variant_type": lambda load: reports.patients_by(
        reports.erbb2(load("genetic_test"), "ICC"), "biomarker_test_type", "biomarker_variant_type"
    ),
    "q_g3_test_types": lambda load: reports.distinct_values(reports.erbb2(load("genetic_test")), "biomarker_test_type"),
    "q_g3_units_of_scores": lambda load: reports.distinct_values(
        reports.scored_genetic(reports.erbb2(load("genetic_test"))), "test_result_1_unit"
    ),
    "q_g3_combined_ish": lambda load: reports.distinct_values(
        reports.scored_genetic(reports.erbb2(load("genetic_test"), *vocab.ISH_TEST_TYPES)), *_COMBINED
    ),
    "q_g3_combined_ihc": lambda load: reports.distinct_values(
        reports.erbb2(load("genetic_test"), "IHC"), *_COMBINED
    ),
    "q_g4_patients_by_unit": lambda load: reports.patients_by(
        reports.named_her2(load("patient_test")).where(F.col("test_value_numeric") == "2+"), "test_unit_name"
    ),
    "q_g5_methods": lambda load: reports.distinct_values(
        reports.named_her2(load("patient_test")), "test_method_name"
    ),
}
_COMBINED = (
    "test_result", "test_result_1_unit", "test_result_1_numeric", "test_result_2_unit", "test_result_2_numeric",
)
for _kind, _types in {"ish": vocab.ISH_TEST_TYPES, "ihc": ("IHC",)}.items():
    for _i in (1, 2):
        REPORTS[f"q_g3_result_{_i}_{_kind}"] = lambda load, i=_i, types=_types: reports.distinct_values(
            reports.erbb2(load("genetic_test"), *types), f"test_result_{i}_numeric", f"test_result_{i}_unit"
        )

# Each of the ten receptor groups is also a query of its own.
RECEPTOR_GROUPS = (
    "hr_pos_borderline_fish_negative",
    "hr_pos_borderline_fish_negative_or_missing",
    "hr_pos_low_fish_negative",
    "hr_pos_low_fish_negative_or_missing",
    "hr_neg_borderline_fish_negative",
    "hr_neg_borderline_fish_negative_or_missing",
    "hr_neg_low_fish_negative",
    "hr_neg_low_fish_negative_or_missing",
    "hr_pos_her2_negative",
    "triple_negative",
)
# All that is asked of the wide table, by source.
_PREVIEW = {"q_h18_wide_preview": reports.preview}
_GROUPS = {
    f"q_h{i:02d}_{group}": _count(lambda group=group: reports.receptor_conditions()[group])
    for i, group in enumerate(RECEPTOR_GROUPS, start=1)
}
_COUNTS = {
    "q_h11_strict_negative": _count(_hr_positive_strict),
    "q_h12_any_her2": _count(reports.any_her2),
    "q_h13_wide": _count(),
}
# The current rules have their own names for the low results.
_LOW_CURRENT = {"borderline": ("Low2+",), "low": ("Low1+", "Low2+")}
WIDE_REPORTS: dict[str, dict[str, Callable[[DataFrame], DataFrame]]] = {
    "revised": {"receptor_report": reports.receptor_report, **_COUNTS, **_PREVIEW, **_GROUPS},
    "current": {
        f"{name}_current": report
        for name, report in {"receptor_report": partial(reports.receptor_report, **_LOW_CURRENT), **_COUNTS}.items()
    },
    "genetic": {
        f"{name}_genetic": report
        for name, report in {"receptor_report": reports.receptor_report, **_PREVIEW, **_GROUPS}.items()
    },
}
for _source, _asked in WIDE_REPORTS.items():
    for _name, _report in _asked.items():
        REPORTS[_name] = lambda load, report=_report, source=_source: report(pipelines.receptor_status(load, source))


def staged_reports(load: Load, source: str = "revised", shared_mount: bool = False) -> dict[str, DataFrame]:
    """Every report on the wide table by name, all from one stored build of it."""
    wide = store_stage(pipelines.receptor_status(load, source), f"wide-{source}", shared_mount)
    return {name: report(wide) for name, report in WIDE_REPORTS[source].items()}


def staged_counts(load: Load) -> DataFrame:
    """report, n: the single counts of the revised wide table, from one stored build."""
    counts = [
        df.select(F.lit(name).alias("report"), "n")
        for name, df in staged_reports(load).items()
        if df.columns == ["n"]
    ]
    return reduce(DataFrame.union, counts)


REPORTS["s07_staged_counts"] = staged_counts


def _loaded(plan: Callable[[Load], DataFrame]) -> Callable[[Load], DataFrame]:
    """A plan over tables that went through the checks and casts of the loading path."""
    return lambda load: plan(lambda name: conform(delivered(load(name)), name))


LOADED = ("metastatic_on_therapy", "receptor_wide_genetic", "ras_secondary_percent")
REPORTS |= {f"{name}_loaded": _loaded(COMPOSITES[name]) for name in LOADED}

ALL: dict[str, Callable[[Load], DataFrame]] = {**COMPOSITES, **REPORTS, **PRIMITIVES}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(ALL[name](cache(partial(view, spark, sf_dir))))
