"""Single-operator queries: each shows one building block on a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oncolens.functions import vocab
from oncolens.functions.columns import (
    day_diff,
    drop_plus,
    ends_with_plus,
    first_match,
    matches,
    month_diff,
    one_of,
    percent,
)
from oncolens.functions.patterns import similar_to
from oncolens.operators import her2, nearest, ras, receptor, windowed
from oncolens.operators.grouping import (
    count_patients,
    group_stats,
    join_per_patient,
    keys_in,
    keys_not_in,
    left_join_many,
)
from oncolens.plans import pipelines, reports
from oncolens.plans.pipelines import Load

col = F.col


# --- projections and predicates -------------------------------------------
def p01_projection(load: Load) -> DataFrame:
    return load("genetic_test").select(
        "patient_id",
        col("report_date").alias("test_date"),
        col("biomarker_test_type").alias("test_method_name"),
        col("biomarker_name").alias("test_name_name"),
    )


def p02_select_star(load: Load) -> DataFrame:
    return load("drug").select("*", F.lower("antineoplastic").alias("use"))


def p03_literal_columns(load: Load) -> DataFrame:
    return windowed.receptor_diagnoses(load("condition")).select(
        "patient_id", F.lit("ER").alias("biomarker"), F.lit("IHC").alias("test_method"), F.lit(1).alias("correct_tab")
    )


def p04_typed_nulls(load: Load) -> DataFrame:
    diagnoses = load("condition").select(
        "patient_id", F.lit(None).cast("string").alias("test_unit_name"), col("diagnosis_date").alias("test_date")
    )
    return load("patient_test").select("patient_id", "test_unit_name", "test_date").union(diagnoses).distinct()


def p09_comparison(load: Load) -> DataFrame:
    return load("drug").where((col("antineoplastic") != "never") & col("drug_code").between(10, 1_000_000_000))


def p10_in_list(load: Load) -> DataFrame:
    return reports.erbb2(load("genetic_test"), *vocab.ISH_TEST_TYPES).select(
        "patient_id", "biomarker_test_type", "test_result_1_numeric", "test_result_1_unit"
    )


def p11_null_or_match(load: Load) -> DataFrame:
    numeric = col("test_value_numeric")
    return (
        load("patient_test")
        .where(col("test_date").isNotNull() & (numeric.isNull() | one_of("test_value_numeric", vocab.FISH_SCORES)))
        .select("patient_id", "test_date", "test_value_numeric")
    )


def p12_precedence(load: Load) -> DataFrame:
    rules = windowed.receptor_rules("%immunohisto%", "immuno%")
    wanted = (col("test_date").isNotNull() & rules["ER"]) | rules["PR"] | rules["ER/PR"]
    return load("patient_test").where(wanted).select("patient_id", "test_date", "test_name_code", "test_method_name")


def p13_like(load: Load) -> DataFrame:
    return (
        load("biomarker_table")
        .where(col("biomarker_name_name").like("%RAS"))
        .select("patient_id", "biomarker_name_name", "test_result_name")
    )


def p14_ends_with_plus(load: Load) -> DataFrame:
    return (
        load("patient_test")
        .where(ends_with_plus(col("test_value_numeric")))
        .select("patient_id", "test_value_numeric", "test_date")
    )


def p15_ilike(load: Load) -> DataFrame:
    return (
        load("medication")
        .where(~col("med_route_name").ilike("%intravenous%"))
        .select("patient_id", "med_generic_name_code", "med_route_name")
    )


def p16_similar_to(load: Load) -> DataFrame:
    return (
        load("patient_test")
        .where(similar_to(F.lower("genetic_test_type_name"), vocab.AMPLIFICATION_TEST_TYPES))
        .select("patient_id", "test_name_code", "genetic_test_type_name")
    )


def p17_regex(load: Load) -> DataFrame:
    return (
        load("biomarker_table")
        .where(matches(col("molecular_variant"), "c.35G>C|p.G12A|c.34G>T|183a"))
        .select("patient_id", "molecular_variant")
    )


def p18_not_regex(load: Load) -> DataFrame:
    return (
        load("biomarker_table")
        .where(~matches(col("variant_classification_name"), vocab.HARMLESS_CLASSES))
        .select("patient_id", "variant_classification_name")
    )


# --- scalar functions -----------------------------------------------------
def f01_case(load: Load) -> DataFrame:
    name = col("diagnosis_code_name")
    labelled = first_match([(name.ilike("%positive%"), "Positive"), (name.ilike("%negative%"), "Negative")])
    return load("condition").select("patient_id", "diagnosis_code_code", labelled.alias("test_result"))


def f02_lower(load: Load) -> DataFrame:
    return load("stage").select("patient_id", F.lower("stage_group_name").alias("stage_group"))


def f03_replace(load: Load) -> DataFrame:
    return load("patient_test").select("patient_id", drop_plus(col("test_value_numeric")).alias("number"))


def f04_length(load: Load) -> DataFrame:
    return load("stage").select(
        "patient_id", "stage_date_collected", F.length("stage_date_collected").alias("n_chars")
    )


def _diagnosis_gap(load: Load) -> DataFrame:
    """Receptor diagnoses beside the patient's onset: many rows to one."""
    diagnoses = windowed.receptor_diagnoses(load("condition")).select("patient_id", "diagnosis_date")
    return join_per_patient(diagnoses, pipelines.metastatic_onset(load))


def f05_abs(load: Load) -> DataFrame:
    gap = F.abs(day_diff(col("met_date"), col("diagnosis_date")))
    return _diagnosis_gap(load).select("patient_id", "diagnosis_date", gap.alias("days_apart"))


def f06_day_diff(load: Load) -> DataFrame:
    return load("patient_test").select(
        "patient_id",
        "test_date",
        "test_collection_date",
        day_diff(col("test_date"), col("test_collection_date")).alias("days"),
    )


def f07_month_diff(load: Load) -> DataFrame:
    return load("patient_test").select(
        "patient_id",
        "test_date",
        "test_collection_date",
        month_diff(col("test_date"), col("test_collection_date")).alias("months"),
    )


def f08_trunc_to_date(load: Load) -> DataFrame:
    stamped = load("stage").withColumn("stamp", col("stage_date").cast("timestamp_ntz") + F.expr("INTERVAL 23 HOURS"))
    return stamped.select("patient_id", F.to_date("stamp").alias("stage_day"))


def f09_year(load: Load) -> DataFrame:
    return load("condition").select("patient_id", F.year("diagnosis_date").alias("diagnosis_year"))


def f10_percent(load: Load) -> DataFrame:
    return (
        load("patient_test")
        .groupBy("test_name_code")
        .agg(percent(F.count("test_date"), F.count("*")).alias("percent_dated"))
    )


def f11_date_literal(load: Load) -> DataFrame:
    return load("stage").where(col("stage_date") >= F.lit("1998-01-01").cast("date")).select("patient_id", "stage_date")


# --- joins ----------------------------------------------------------------
def j01_inner_using(load: Load) -> DataFrame:
    return _diagnosis_gap(load).select("patient_id", "met_date", "diagnosis_date")


def j02_inner_on(load: Load) -> DataFrame:
    codes = pipelines.antineoplastic_codes(load)
    return (
        load("medication")
        .join(codes, col("med_generic_name_code") == col("rxcui"))
        .select("patient_id", "rxcui", "drug_name", "med_status")
    )


def j03_dimension_chain(load: Load) -> DataFrame:
    return (
        load("drug")
        .join(load("drug_rxnorm_map"), "drug_code")
        .join(load("drug_condition"), "drug_code")
        .join(load("drug_cohort"), "condition_code")
        .select("rxcui", "drug_name", "patient_cohort")
    )


def side_tables(load: Load) -> tuple[DataFrame, DataFrame]:
    cdx = load("stage").groupBy("patient_id").agg(F.count("*").alias("n_stage_rows"))
    mdx = load("biomarker_table").groupBy("patient_id").agg(F.count("*").alias("n_biomarker_rows"))
    return cdx, mdx


def j04_two_left_joins(load: Load) -> DataFrame:
    cdx, mdx = side_tables(load)
    return pipelines.metastatic_onset(load).join(cdx, "patient_id", "left").join(mdx, "patient_id", "left")


def j05_left_one_to_many(load: Load) -> DataFrame:
    diagnoses = windowed.receptor_diagnoses(load("condition")).select(
        "patient_id", "diagnosis_date", "diagnosis_code_code"
    )
    return left_join_many(pipelines.metastatic_onset(load), diagnoses)


def j06_month_band(load: Load) -> DataFrame:
    """Onset beside the patient's distinct test days in the band: the cohort has one row a patient."""
    days = pipelines.her2_tests(load).select("patient_id", "test_date").distinct()
    joined = pipelines.metastatic_onset(load).join(days, "patient_id")
    return joined.where(month_diff(col("met_date"), col("test_date")).between(-12, 1))


def j07_nearest(load: Load) -> DataFrame:
    """Distinct HER2 test days with the nearest receptor diagnosis day(s), either side."""
    tests = pipelines.her2_tests(load).where(col("test_date").isNotNull()).select("patient_id", "test_date").distinct()
    diagnoses = windowed.receptor_diagnoses(load("condition"))
    return nearest.nearest_days(tests, "test_date", diagnoses, "diagnosis_date", "nearest_day")


def j08_semi_for_distinct(load: Load) -> DataFrame:
    return windowed.with_test_in_window(pipelines.metastatic_onset(load), pipelines.her2_tests(load))


def j09_in_subquery(load: Load) -> DataFrame:
    biomarker = load("biomarker_table")
    amplified = biomarker.where(col("biomarker_variant_type_name") == "Gene Amplification")
    return keys_in(biomarker, amplified).select("patient_id", "biomarker_name_name", "report_date")


def j10_not_in_subquery(load: Load) -> DataFrame:
    second = load("condition").where(col("diagnosis_type_code") == vocab.SECOND_PRIMARY_CODE)
    return keys_not_in(pipelines.metastatic_onset(load), second, merged=True, null_aware=True)


def j11_scalar_subqueries(load: Load) -> DataFrame:
    return count_patients(
        load("biomarker_table"),
        kras=col("biomarker_name_name") == "KRAS",
        any_ras=col("biomarker_name_name").like("%RAS"),
    ).select(percent(col("kras"), col("any_ras")).alias("percent_kras"))


# --- aggregation ----------------------------------------------------------
def a01_count(load: Load) -> DataFrame:
    return load("patient_test").agg(F.count("*").alias("n"))


def a02_count_distinct(load: Load) -> DataFrame:
    return load("patient_test").agg(F.count_distinct("patient_id").alias("n"))


def a03_count_distinct_grouped(load: Load) -> DataFrame:
    return reports.patients_by(load("genetic_test"), "biomarker_name", "biomarker_test_type")


def a04_min(load: Load) -> DataFrame:
    return load("stage").groupBy("patient_id").agg(
        F.min("stage_date").alias("first_date"), F.min("stage_date_collected").alias("first_text")
    )


def a05_sum_flags(load: Load) -> DataFrame:
    flag = F.when(col("curation_indicator") == 1, 1)
    return load("patient_test").groupBy("patient_id").agg(F.sum(flag).alias("curated"))


def a06_having(load: Load) -> DataFrame:
    return a05_sum_flags(load).where(col("curated") > 20)


def a08_group_by_case(load: Load) -> DataFrame:
    return reports.patients_by(ras.with_variant(load("biomarker_table")), "variant")


def a09_pivot(load: Load) -> DataFrame:
    """Largest result text per patient, in one column per test method."""
    cells = [
        F.max(F.when(col("test_method") == method, col("test_result"))).alias(f"largest_{method.lower()}")
        for method in ("IHC", "FISH")
    ]
    return pipelines.labelled_merged(load).groupBy("patient_id").agg(*cells)


def a10_distinct(load: Load) -> DataFrame:
    return reports.distinct_values(load("patient_test"), "test_name_code", "test_method_name", "test_unit_name")


# --- windows --------------------------------------------------------------
def w01_dense_rank_value(load: Load) -> DataFrame:
    return ras.ras_variant_ranks(load("biomarker_table"))


def w02_dense_rank_distance(load: Load) -> DataFrame:
    days = pipelines.er_pr_tests(load).join(pipelines.metastatic_onset(load), "patient_id")
    return nearest.rank_by_distance(
        days, ("patient_id", "met_date"), "met_date", "test_date", "datediffer", "closest_test"
    )


def w03_dense_rank_distance_by_test(load: Load) -> DataFrame:
    return receptor.ranked_by_onset(pipelines.receptor_tests(load), pipelines.metastatic_onset(load))


def _clinical(load: Load) -> DataFrame:
    return her2.clean_result(her2.label_method(load("patient_test"))).select(*her2.SAME_DAY, "test_result")


def w04_group_min_max(load: Load) -> DataFrame:
    return group_stats(
        _clinical(load), her2.SAME_DAY, smallest=F.min("test_result"), largest=F.max("test_result")
    )


def w05_all_equal(load: Load) -> DataFrame:
    spans = [F.min("test_result").alias("smallest"), F.max("test_result").alias("largest"), F.count("*").alias("rows")]
    groups = _clinical(load).groupBy(*her2.SAME_DAY).agg(*spans)
    return groups.groupBy((col("smallest") == col("largest")).alias("all_equal")).agg(F.sum("rows").alias("n"))


def w06_any_conflict(load: Load) -> DataFrame:
    conflict = F.when(col("smallest") != col("largest"), "conflicting").otherwise("none")
    return w04_group_min_max(load).select("patient_id", "test_date", "test_result", conflict.alias("conflict"))


def w07_keep_best_rank(load: Load) -> DataFrame:
    return nearest.keep_nearest(w02_dense_rank_distance(load))


# --- sort, limit, set operations, update ----------------------------------
def o01_order_by(load: Load) -> DataFrame:
    return reports.sorted_by(pipelines.metastatic_onset(load), "met_date", "patient_id")


def o02_limit(load: Load) -> DataFrame:
    """The most tested patients; Spark keeps the best 20 of each task and merges those."""
    counted = load("patient_test").groupBy("patient_id").agg(F.count("*").alias("n_tests"))
    return counted.orderBy(col("n_tests").desc(), "patient_id").limit(20)


def u01_union(load: Load) -> DataFrame:
    staged = load("stage").where(col("stage_group_name").ilike("stage 4%")).select("patient_id", col("stage_date").alias("day"))
    positive = load("biomarker_table").where(col("test_result_name") == "Positive").select("patient_id", "report_date")
    return staged.union(positive).distinct()


def u02_except(load: Load) -> DataFrame:
    biomarker = load("biomarker_table").where(col("biomarker_name_name") == "KRAS")
    negative = biomarker.where(col("test_result_name") == "Negative").select("patient_id")
    positive = biomarker.where(one_of("test_result_name", vocab.AMPLIFIED_RESULTS)).select("patient_id")
    # Both lists are merged first: the difference itself compares every row.
    return negative.distinct().subtract(positive.distinct())


def u03_update(load: Load) -> DataFrame:
    """Both columns are set from the old row, as an UPDATE does."""
    undone = col("curation_indicator") == 0
    return (
        load("stage")
        .withColumns(
            {
                "mstage_name": F.when(undone, "unknown").otherwise(col("mstage_name")),
                "curation_indicator": F.when(undone, 1).otherwise(col("curation_indicator")),
            }
        )
        .select("patient_id", "stage_date", "mstage_name", "curation_indicator")
    )


_ALL = (
    p01_projection, p02_select_star, p03_literal_columns, p04_typed_nulls, p09_comparison, p10_in_list,
    p11_null_or_match, p12_precedence, p13_like, p14_ends_with_plus, p15_ilike, p16_similar_to, p17_regex,
    p18_not_regex, f01_case, f02_lower, f03_replace, f04_length, f05_abs, f06_day_diff, f07_month_diff,
    f08_trunc_to_date, f09_year, f10_percent, f11_date_literal, j01_inner_using, j02_inner_on, j03_dimension_chain,
    j04_two_left_joins, j05_left_one_to_many, j06_month_band, j07_nearest, j08_semi_for_distinct, j09_in_subquery,
    j10_not_in_subquery, j11_scalar_subqueries, a01_count, a02_count_distinct, a03_count_distinct_grouped, a04_min,
    a05_sum_flags, a06_having, a08_group_by_case, a09_pivot, a10_distinct, w01_dense_rank_value,
    w02_dense_rank_distance, w03_dense_rank_distance_by_test, w04_group_min_max, w05_all_equal, w06_any_conflict,
    w07_keep_best_rank, o01_order_by, o02_limit, u01_union, u02_except, u03_update,
)
PRIMITIVES = {fn.__name__: fn for fn in _ALL}
