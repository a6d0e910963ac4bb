"""Hand-checked rows for the metastatic cohort."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from oncolens.functions import vocab
from oncolens.functions.columns import day_diff, month_diff, percent
from oncolens.operators import grouping, onset, receptor, windowed
from oncolens.plans import registry
from tests.conftest import SF


def stage_row(patient, day, text, curated=1, group="Stage 4B", m=None):
    return dict(
        patient_id=patient, curation_indicator=curated, stage_date=day, stage_date_collected=text,
        stage_group_name=group, mstage_name=m,
    )


def test_onset_needs_a_month_in_the_smallest_collected_text(table, rows_of):
    stage = table(
        "stage",
        stage_row(1, "2018-01-01", "2018"),
        stage_row(1, "2018-05-01", "2018-05-01"),
        stage_row(2, "2019-03-01", "2019-03"),
        stage_row(3, "2019-03-01", "2019-03", curated=0),
        stage_row(4, "2020-01-10", "2020-01-10", group=None, m="cM1a"),
        stage_row(5, "2020-01-10", "2020-01-10", group="Stage 2", m="M0"),
    )
    condition = table(
        "condition",
        dict(patient_id=4, curation_indicator=1, diagnosis_date="2019-12-01", diagnosis_date_collected="2019-12-01",
             diagnosis_type_name="METASTATIC neoplasm"),
        dict(patient_id=6, curation_indicator=1, diagnosis_date=None, diagnosis_date_collected="2019-12",
             diagnosis_type_name="metastatic"),
    )
    got = rows_of(onset.metastatic_onset(stage, condition), "patient_id", "met_date")
    assert got == {(2, "2019-03-01"), (4, "2019-12-01"), (6, None)}


def test_one_failing_source_leaves_the_other(table, rows_of):
    stage = table("stage", stage_row(1, "2015-01-01", "2015"))
    condition = table(
        "condition",
        dict(patient_id=1, curation_indicator=1, diagnosis_date="2016-02-01", diagnosis_date_collected="2016-02",
             diagnosis_type_name="metastatic"),
    )
    assert rows_of(onset.metastatic_onset(stage, condition), "patient_id", "met_date") == {(1, "2016-02-01")}


def test_codes_keep_drugs_that_are_ever_used(frame, rows_of):
    drug = frame(
        "drug_code bigint, drug_name string, broad_category string, antineoplastic string",
        (1, "a", "x", None), (2, "b", "x", "never"), (3, "c", "x", "always"), (4, "d", "x", "sometimes"),
    )
    names = frame("drug_code bigint, rxcui string", *[(i, str(i)) for i in (1, 2, 3, 4)])
    uses = frame("drug_code bigint, condition_code bigint", (1, 7), (2, 7), (3, 7), (4, 8))
    cohorts = frame("condition_code bigint, patient_cohort string", (7, "breast"), (8, "lung"))
    assert rows_of(onset.antineoplastic_codes(drug, names, uses, cohorts), "rxcui") == {("3",)}
    assert rows_of(onset.antineoplastic_codes(drug, names, uses, cohorts, "lung"), "rxcui") == {("4",)}


def test_therapy_route_and_status(frame, table, rows_of):
    codes = frame("rxcui string, drug_name string, broad_category string", ("9", "a", "x"), ("9", "a", "y"))
    rows = [
        (1, None, "ordered"), (2, None, "administered"), (3, "Oral", "ordered"), (4, "Intravenous push", "ordered"),
        (5, "Intravenous push", "administered"), (6, "Oral", None), (7, None, None),
    ]
    medication = table(
        "medication",
        *[dict(patient_id=p, med_generic_name_code="9", med_generic_name_name="g", med_route_name=r, med_status=s)
          for p, r, s in rows],
        dict(patient_id=8, med_generic_name_code="1", med_route_name="Oral"),
        dict(patient_id=2, med_generic_name_code="9", med_generic_name_name="g", med_status="administered"),
    )
    therapy = onset.systemic_therapy(medication, codes)
    assert rows_of(therapy, "patient_id") == {(2,), (3,), (5,), (6,)}
    assert therapy.count() == 4


def test_second_primary_counts_month_boundaries_and_drops_the_patient(frame, table, rows_of):
    cohort = frame(
        "patient_id bigint, met_date date",
        (1, "2018-01-31"), (2, "2018-01-31"), (3, "2018-01-31"), (4, "2018-01-31"), (4, "2025-01-01"),
    )
    condition = table(
        "condition",
        *[dict(patient_id=p, curation_indicator=c, diagnosis_date=d, diagnosis_type_code="109359008")
          for p, d, c in [(1, "2021-01-01", 1), (2, "2021-02-01", 1), (3, "2018-01-01", 0), (4, "2018-01-01", 1)]],
    )
    kept = onset.exclude_second_primary(cohort, condition)
    # Patient 4 has a second onset far from the other primary, and still goes.
    assert rows_of(kept, "patient_id") == {(2,), (3,)}


def test_month_band(frame, rows_of):
    cohort = frame("patient_id bigint, met_date date", *[(i, "2018-01-31") for i in (1, 2, 3, 4, 5)])
    tests = frame(
        "patient_id bigint, test_date date",
        (1, "2018-02-28"), (2, "2018-03-01"), (3, "2017-01-01"), (4, "2016-12-31"), (5, None),
    )
    kept = windowed.with_test_in_window(cohort, tests)
    assert rows_of(kept, "patient_id") == {(1,), (3,)}
    assert rows_of(windowed.with_both_tests_in_window(cohort, tests, tests, lo=-13, hi=2), "patient_id") == {
        (1,), (2,), (3,), (4,),
    }


def test_her2_filter_methods_differ(table, rows_of):
    tests = table(
        "patient_test",
        *[dict(patient_id=i, test_name_code=c, test_method_name=m, genetic_test_type_name=g, test_value_numeric=n)
          for i, (c, m, g, n) in enumerate([
              ("18474-7", None, None, None),
              ("3430", "Fluoro immunoassay", None, None),
              ("3430", "Immunohistochemistry", None, None),
              ("C16152", "FISH", "Gene amplification", None),
              ("C16152", "FISH", "Mutation", None),
              ("C16152", "in situ", None, None),
              ("C16152", None, None, None),
              ("48676-1", None, None, "2+"),
              ("48676-1", None, None, "1.0"),
              ("48676-1", None, None, None),
              ("3430", "sequencing", None, None),
          ])],
    )
    contains = {i for (i,) in rows_of(windowed.her2_test_filter(tests), "patient_id")}
    prefix = {i for (i,) in rows_of(windowed.her2_test_filter(tests, vocab.METHODS_PREFIX), "patient_id")}
    assert contains == {0, 1, 2, 3, 5, 7, 9}
    assert prefix == contains - {1}


def test_er_pr_dates(table, rows_of):
    tests = table(
        "patient_test",
        dict(patient_id=1, test_name_code="14228-1", test_date=None),
        dict(patient_id=2, test_name_code="16113-3", test_date=None),
        dict(patient_id=3, test_name_code="3467", test_method_name="IMMUNOHISTO", test_date="2000-01-01"),
        dict(patient_id=4, test_name_code="3467", test_method_name="immunoassay", test_date="2000-01-01"),
        dict(patient_id=5, test_name_name="Hormone Receptor", test_method_name="Immunoassay", test_date="2000-01-01"),
        dict(patient_id=6, test_name_name="Hormone Receptor", test_method_name="an immunoassay", test_date="2000-01-01"),
    )
    condition = table("condition", dict(patient_id=7, diagnosis_code_code="xz17.0", diagnosis_date="2001-01-01"))
    got = rows_of(windowed.er_pr_tests(tests, condition), "patient_id", "test_date")
    assert got == {(2, None), (3, "2000-01-01"), (5, "2000-01-01"), (7, "2001-01-01")}


def test_date_arithmetic(spark):
    df = spark.sql(
        "SELECT timestamp'2020-01-31 23:00:00' AS a, timestamp'2020-02-01 01:00:00' AS b, date'2019-12-31' AS c"
    )
    row = df.select(
        day_diff(F.col("a"), F.col("b")).alias("days"),
        month_diff(F.col("a"), F.col("b")).alias("months"),
        month_diff(F.col("b"), F.col("c")).alias("back"),
    ).first()
    assert (row.days, row.months, row.back) == (1, 1, -2)


@pytest.mark.parametrize("part, whole, want", [(1, 4, 25.0), (0, 4, 0.0), (1, 0, None)])
def test_percent_guards_zero(spark, part, whole, want):
    df = spark.range(1).select(F.lit(part).alias("p"), F.lit(whole).alias("w"))
    assert df.select(percent(F.col("p"), F.col("w")).alias("x")).first().x == want


def test_enrich_cohort_filters_the_patients_only(frame, rows_of):
    pts = frame("patient_id bigint, met_date date", (1, "2018-01-01"), (2, "2017-12-31"), (3, "2020-05-05"))
    cdx = frame("patient_id bigint, a int", (1, 10), (1, 11), (2, 12))
    mdx = frame("patient_id bigint, b int", (1, 20))
    got = rows_of(receptor.enrich_cohort(pts, cdx, mdx, "2018-01-01"), "patient_id", "a", "b")
    assert got == {(1, 10, 20), (1, 11, 20), (3, None, None)}


def test_cohort_bits_hold_every_key(spark):
    rows = spark.range(0, 60_000).withColumnRenamed("id", "patient_id")
    cohort = rows.where("patient_id % 41 = 3").selectExpr("CAST(patient_id AS INT) AS patient_id", "1 AS x")
    for n_bits in (1 << 15, 1 << 20):
        kept = rows.where(grouping.may_hold(grouping.cohort_bits(cohort, n_bits=n_bits), n_bits=n_bits))
        assert cohort.join(kept, "patient_id", "left_anti").count() == 0
        assert kept.count() < cohort.count() * (1.3 if n_bits > 1 << 15 else 6)
    nobody = grouping.cohort_bits(cohort.where("x = 2").union(spark.sql("SELECT CAST(NULL AS INT), 1")))
    assert rows.where(grouping.may_hold(nobody)).count() == 0
    names = spark.createDataFrame([("a",), ("b",), (None,)], "patient_id string")
    assert [r[0] for r in names.where(grouping.may_hold(grouping.cohort_bits(names.limit(1)))).collect()] == ["a"]


def test_band_of_any_width_equals_pairing_everything(spark, frame):
    """Every distance from the band's ends, over bitmap borders and centuries."""
    days = [f"{year}-{month:02d}-15" for year in (1899, 1969, 1970, 1997, 1998, 1999, 2005, 2040) for month in range(1, 13)]
    cohort = frame("patient_id bigint, met_date date", *[(k % 3, d) for k, d in enumerate(days)])
    her2 = frame("patient_id bigint, test_date date", *[(k % 3, d) for k, d in enumerate(days[5::7])], (0, None))
    er_pr = frame("patient_id bigint, test_date date", *[(k % 4, d) for k, d in enumerate(days[1::5])])
    for lo, hi in ((-12, 1), (0, 0), (-31, 32), (2, 5), (-3, -1)):
        near = [
            f"EXISTS (SELECT 1 FROM {t} AS t WHERE t.patient_id = c.patient_id AND (year(test_date) - year(met_date)) * 12"
            f" + month(test_date) - month(met_date) BETWEEN {lo} AND {hi})"
            for t in ("her2_t", "er_pr_t")
        ]
        for name, df in (("c", cohort), ("her2_t", her2), ("er_pr_t", er_pr)):
            df.createOrReplaceTempView(name)
        for kept, where in (
            (windowed.with_test_in_window(cohort, her2, lo, hi), near[0]),
            (windowed.with_both_tests_in_window(cohort, her2, er_pr, lo, hi), " AND ".join(near)),
        ):
            want = spark.sql(f"SELECT DISTINCT patient_id, met_date FROM c WHERE {where}")
            assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError, match="band"):
        windowed.with_test_in_window(cohort, her2, -40, 40)


def test_funnel_equals_its_steps(spark):
    one = registry.run("funnel_counts", spark, SF).first().asDict()
    assert one == {name: registry.run(name, spark, SF).first()["n"] for name in one}
    assert len(one) == 5 and min(one.values()) > 0
