"""ER/PR labelling, the combined receptor table, and one row of status per patient."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oncolens.functions import vocab
from oncolens.functions.columns import drop_plus, first_match, one_of
from oncolens.operators.grouping import agreeing_groups, drop_conflicting_groups
from oncolens.operators.her2 import SAME_DAY, method_mentions
from oncolens.operators.nearest import keep_nearest, rank_by_distance
from oncolens.operators.windowed import receptor_diagnoses, receptor_rules

LABEL_COLUMNS = (
    "patient_id", "test_name_name", "test_method_name", "test_value_name", "test_value_numeric", "test_date",
    "biomarker", "test_method", "test_result", "test_value_numeric_cleaned",
)
GENETIC_COLUMNS = (
    "patient_id", "test_date", "test_collection_date", "test_method_name", "test_name_name", "test_value_name",
    "test_value_numeric", "test_unit_name", "biomarker",
)
# All that conflict detection and the combined table look at.
CONFLICT_COLUMNS = (*SAME_DAY, "biomarker", "test_method", "test_result")
RECEPTOR_COLUMNS = ("patient_id", "biomarker", "test_result", "test_date", "test_method")

# Also recognises genetic IHC/ICC rows and receptor diagnoses.
IHC_PATTERN_FIXED = "%(immun|ihc|icc)%"


def _receptor_rows(patient_test: DataFrame) -> DataFrame:
    """Receptor tests with their biomarker. Selection wants immunohisto (or a panel
    method that starts with immun), the label is content with immun anywhere."""
    selected = receptor_rules("%immunohisto%", "immun%")
    labels = receptor_rules("%immun%", "%immun%")
    biomarker = first_match([(condition, name) for name, condition in labels.items()])
    return patient_test.where(selected["ER"] | selected["PR"] | selected["ER/PR"]).withColumn("biomarker", biomarker)


def _diagnosis_result():
    name = F.col("diagnosis_code_name")
    return first_match([(name.ilike("%positive%"), "Positive"), (name.ilike("%negative%"), "Negative")])


def _clean_receptor_result(tests: DataFrame) -> DataFrame:
    name = F.col("test_value_name")
    result = first_match(
        [
            (one_of("test_value_name", vocab.NEGATIVE_NAMES), "Negative"),
            (one_of("test_value_name", vocab.UNKNOWN_RECEPTOR_NAMES) | name.isNull(), "Unknown"),
        ],
        otherwise=name,
    )
    return tests.withColumns(
        {"test_result": result, "test_value_numeric_cleaned": drop_plus(F.col("test_value_numeric"))}
    )


def _with_columns_of(df: DataFrame, like: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` of df, the absent ones as nulls of the type they have in ``like``."""
    kinds = {f.name: f.dataType for f in like.schema}
    return df.select(*[c if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns])


def er_pr_label(
    patient_test: DataFrame, condition: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Distinct labelled ER/PR tests, with receptor diagnoses as ER results by IHC.

    ``columns`` narrows the rows and leaves copies to the caller.
    """
    tests = _clean_receptor_result(_receptor_rows(patient_test)).withColumn(
        "test_method", F.when(method_mentions(vocab.IHC_PATTERN), "IHC").otherwise("Not Specified")
    )
    diagnoses = receptor_diagnoses(condition).select(
        "patient_id",
        F.col("diagnosis_date").alias("test_date"),
        F.lit("ER").alias("biomarker"),
        F.lit("IHC").alias("test_method"),
        _diagnosis_result().alias("test_result"),
    )
    chosen = columns or LABEL_COLUMNS
    rows = tests.select(*chosen).union(_with_columns_of(diagnoses, tests, chosen))
    return rows if columns else rows.distinct()


def er_pr_label_with_genetic(
    patient_test: DataFrame,
    genetic_test: DataFrame,
    condition: DataFrame,
    fix_ihc_label: bool = False,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """As ``er_pr_label`` with ESR1/PGR stains of the genetic table.

    By default only ``immun`` in the method or name reads as IHC, so rows whose method
    is the bare word IHC or ICC (genetic rows, diagnoses) end up under the other label
    and leave the wide table. ``fix_ihc_label=True`` reads those words as IHC too.
    """
    clinical = _receptor_rows(patient_test).select(*GENETIC_COLUMNS)
    gene = F.col("biomarker_name")
    genetic = genetic_test.where(
        one_of("biomarker_name", vocab.GENE_TO_RECEPTOR)
        & one_of("biomarker_test_type", vocab.RECEPTOR_GENE_TEST_TYPES)
    ).select(
        "patient_id",
        F.col("report_date").alias("test_date"),
        F.col("specimen_collected_date").alias("test_collection_date"),
        F.col("biomarker_test_type").alias("test_method_name"),
        gene.alias("test_name_name"),
        F.col("test_result").alias("test_value_name"),
        F.col("test_result_2_numeric").alias("test_value_numeric"),
        F.col("test_result_2_unit").alias("test_unit_name"),
        first_match([(gene == g, receptor) for g, receptor in vocab.GENE_TO_RECEPTOR.items()]).alias("biomarker"),
    )
    diagnoses = receptor_diagnoses(condition).select(
        "patient_id",
        F.col("diagnosis_date").alias("test_date"),
        F.lit("IHC").alias("test_method_name"),
        _diagnosis_result().alias("test_value_name"),
        F.lit("ER").alias("biomarker"),
    )
    rows = clinical.union(genetic).union(_with_columns_of(diagnoses, clinical, GENETIC_COLUMNS))
    pattern = IHC_PATTERN_FIXED if fix_ihc_label else vocab.IHC_PATTERN
    method = F.when(method_mentions(pattern), "IHC").otherwise(vocab.OTHER_METHOD)
    if columns:
        return _clean_receptor_result(rows).withColumn("test_method", method).select(*columns)
    return _clean_receptor_result(rows.distinct()).withColumn("test_method", method)


def drop_same_day_conflicts(er_pr: DataFrame) -> DataFrame:
    """Without the tests whose results disagree within a patient's day, name and method."""
    return drop_conflicting_groups(er_pr, SAME_DAY, "test_result")


def settled_receptors(er_pr: DataFrame) -> DataFrame:
    """Distinct RECEPTOR_COLUMNS of ``drop_same_day_conflicts``, copies allowed in the input.

    A group that agrees holds one result and missing ones, under a few pairs of biomarker
    and method; one aggregate that combines map-side gives them.
    """
    label = F.struct("biomarker", "test_method", F.col("test_result").isNull().alias("missing"))
    groups = agreeing_groups(er_pr, SAME_DAY, "test_result", labels=F.collect_set(label))
    labels = groups.select("patient_id", "test_date", "test_result", F.inline("labels"))
    return labels.withColumn("test_result", F.when(~F.col("missing"), F.col("test_result"))).select(
        *RECEPTOR_COLUMNS
    ).distinct()


def her2_results(nearest: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """HER2 results, one row per test: the IHC and FISH halves of each matched pair are
    unfolded from a single read. Columns ``by`` come first, here and below."""
    halves = F.array(
        *[
            F.struct(
                F.lit("HER2").alias("biomarker"),
                F.col(f"{kind}_test_result").alias("test_result"),
                F.col(f"{kind}_test_date").alias("test_date"),
                F.lit(kind.upper()).alias("test_method"),
            )
            for kind in ("ihc", "fish")
        ]
    )
    return nearest.select(*by, "patient_id", F.inline(halves)).select(*by, *RECEPTOR_COLUMNS)


def receptor_tests(er_pr: DataFrame, nearest: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct ER/PR and HER2 results in one shape."""
    return er_pr.select(*by, *RECEPTOR_COLUMNS).union(her2_results(nearest, by)).distinct()


def ranked_by_onset(tests: DataFrame, onset: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Dated tests of the cohort, ranked by distance from onset per biomarker and method."""
    dated = tests.where(F.col("test_date").isNotNull()).join(onset, "patient_id")
    keys = (*by, "patient_id", "met_date", "biomarker", "test_method")
    ranked = rank_by_distance(dated, keys, "met_date", "test_date", "datediffer", "closest_test")
    return ranked.select(
        *by, "patient_id", "met_date", "test_date", "biomarker", "test_method", "test_result", "datediffer", "closest_test"
    )


def nearest_test_to_onset(tests: DataFrame, onset: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The test(s) of each biomarker and method nearest to onset, ties kept."""
    return keep_nearest(ranked_by_onset(tests, onset, by))


def receptor_wide(nearest: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per patient and onset: a column per receptor and method, and hr_status.

    Tied results are settled by the largest text. Positive needs one positive receptor;
    Negative needs both ER and PR, or the combined test; anything else is null.
    """
    cells = {
        "er": ("ER", "IHC"),
        "pr": ("PR", "IHC"),
        "er_pr": ("ER/PR", "IHC"),
        "her2_ihc": ("HER2", "IHC"),
        "her2_fish": ("HER2", "FISH"),
    }
    largest = [
        F.max(
            F.when((F.col("biomarker") == marker) & (F.col("test_method") == method), F.col("test_result"))
        ).alias(name)
        for name, (marker, method) in cells.items()
    ]
    wide = nearest.where(one_of("test_method", ("FISH", "IHC"))).groupBy(*by, "patient_id", "met_date").agg(*largest)
    er, pr, both = F.col("er"), F.col("pr"), F.col("er_pr")
    status = first_match(
        [
            ((er == "Positive") | (pr == "Positive") | (both == "Positive"), "Positive"),
            (((er == "Negative") & (pr == "Negative")) | (both == "Negative"), "Negative"),
        ]
    )
    return wide.withColumn("hr_status", status)


def enrich_cohort(pts: DataFrame, cdx: DataFrame, mdx: DataFrame, since: str) -> DataFrame:
    """Patients with onset on or after ``since`` and whatever the two side tables hold.

    The side tables describe patients, a row each; many rows of one patient are repeated
    but not split (``left_join_many`` does that, at twice the plan).
    """
    recent = pts.where(F.col("met_date") >= F.lit(since).cast("date"))
    return recent.join(cdx, "patient_id", "left").join(mdx, "patient_id", "left")
