"""Metastatic onset, systemic therapy and second-primary exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oncolens.functions import vocab
from oncolens.functions.columns import month_number
from oncolens.operators.grouping import keys_in


def metastatic_signs(stage: DataFrame, condition: DataFrame) -> DataFrame:
    """Every curated sign of metastasis: patient_id, and day and collected text in the columns of its source."""
    curated = F.col("curation_indicator") == 1
    staged = stage.where(
        curated
        & (
            F.lower("stage_group_name").startswith("stage 4") | F.lower("mstage_name").contains("m1")
        )
    ).select(
        "patient_id",
        F.col("stage_date").alias("stage_day"),
        F.col("stage_date_collected").alias("stage_text"),
        F.lit(None).cast("date").alias("condition_day"),
        F.lit(None).cast("string").alias("condition_text"),
    )
    diagnosed = condition.where(curated & F.lower("diagnosis_type_name").startswith("metastatic")).select(
        "patient_id",
        F.lit(None).cast("date").alias("stage_day"),
        F.lit(None).cast("string").alias("stage_text"),
        F.col("diagnosis_date").alias("condition_day"),
        F.col("diagnosis_date_collected").alias("condition_text"),
    )
    return staged.unionByName(diagnosed)


def metastatic_onset(stage: DataFrame, condition: DataFrame) -> DataFrame:
    """patient_id, met_date: first curated sign of metastasis in either source.

    A source counts for a patient when its smallest collected text is longer than a
    year; that test is independent of which row gives the smallest date. Both sources
    meet in one aggregate, so each patient is shuffled once.
    """
    firsts = metastatic_signs(stage, condition).groupBy("patient_id").agg(
        *[F.min(c).alias(c) for c in ("stage_day", "stage_text", "condition_day", "condition_text")]
    )
    dated = {source: F.length(f"{source}_text") > 4 for source in ("stage", "condition")}
    return firsts.where(dated["stage"] | dated["condition"]).select(
        "patient_id",
        F.least(*[F.when(ok, F.col(f"{source}_day")) for source, ok in dated.items()]).alias("met_date"),
    )


def antineoplastic_codes(
    drug: DataFrame,
    rxnorm_map: DataFrame,
    drug_condition: DataFrame,
    drug_cohort: DataFrame,
    cohort: str = "breast",
) -> DataFrame:
    """rxcui, drug_name, broad_category of the drugs ever used against the cohort's cancer."""
    conditions = drug_cohort.where(F.col("patient_cohort") == cohort).select("condition_code")
    return (
        drug.where(F.col("antineoplastic") != "never")
        .join(rxnorm_map, "drug_code")
        .join(drug_condition, "drug_code")
        .join(conditions, "condition_code")
        .select("rxcui", "drug_name", "broad_category")
    )


def systemic_therapy(medication: DataFrame, codes: DataFrame) -> DataFrame:
    """Distinct patient, code and name of systemic treatments that were really taken.

    Rows are merged before they meet the codes: by then adaptive execution knows the
    size of the code list and can send it to the merged rows instead of shuffling them.
    """
    intravenous = F.lower("med_route_name").contains("intravenous")
    given = F.col("med_status") == "administered"
    taken = ~intravenous | (F.col("med_route_name").isNull() & given) | (intravenous & given)
    drugs = medication.where(taken).select("patient_id", "med_generic_name_code", "med_generic_name_name").distinct()
    listed = codes.select(F.col("rxcui").alias("med_generic_name_code"))
    return drugs.join(listed, "med_generic_name_code", "left_semi").select(
        "patient_id", "med_generic_name_code", "med_generic_name_name"
    )


def metastatic_on_therapy(onset: DataFrame, therapy: DataFrame) -> DataFrame:
    return keys_in(onset, therapy, merged=True).select("patient_id", "met_date").distinct()


def in_years(first: int, last: int) -> Column:
    return F.year("met_date").between(first, last)


def onset_year_between(cohort: DataFrame, first: int, last: int) -> DataFrame:
    return cohort.where(in_years(first, last))


def flag_second_primary(
    cohort: DataFrame, condition: DataFrame, code: str = vocab.SECOND_PRIMARY_CODE, months: int = 36
) -> DataFrame:
    """Cohort rows with ``second_primary``: another curated primary within ``months`` of the row's onset.

    A patient's other primaries are the distinct months of their diagnoses, so few; the
    cohort is read once.
    """
    others = condition.where((F.col("diagnosis_type_code") == code) & (F.col("curation_indicator") == 1))
    others = others.groupBy(F.col("patient_id").alias("other_patient")).agg(
        F.collect_set(month_number(F.col("diagnosis_date"))).alias("other_months")
    )
    onset = month_number(F.col("met_date"))
    near = F.exists("other_months", lambda other: F.abs(other - onset) <= months)
    joined = cohort.join(others, F.col("patient_id") == F.col("other_patient"), "left")
    return joined.withColumn("second_primary", F.coalesce(near, F.lit(False))).select(*cohort.columns, "second_primary")


def exclude_second_primary(
    cohort: DataFrame, condition: DataFrame, code: str = vocab.SECOND_PRIMARY_CODE, months: int = 36
) -> DataFrame:
    """Drop patients with another curated primary within ``months`` of any of their onsets."""
    flagged = flag_second_primary(cohort, condition, code, months)
    anywhere = F.max("second_primary").over(Window.partitionBy("patient_id"))
    return flagged.withColumn("second_primary", anywhere).where(~F.col("second_primary")).select(*cohort.columns)
