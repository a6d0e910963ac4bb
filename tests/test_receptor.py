"""Hand-checked rows for HER2 labelling, FISH matching and receptor status."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from oncolens.functions import vocab
from oncolens.operators import her2, receptor
from oncolens.operators.grouping import count_patients
from oncolens.plans import reports

IHC = "Immunohistochemistry"


def test(patient=1, day="2000-01-01", name="HER2", method=IHC, value=None, number=None, code="18474-7"):
    return dict(
        patient_id=patient, test_name_code=code, test_date=day, test_name_name=name, test_method_name=method,
        test_value_name=value, test_value_numeric=number,
    )


test.__test__ = False


@pytest.mark.parametrize(
    "method, name, want, genetic",
    [
        ("FISH", "HER2 by immunoassay", "IHC", "IHC"),
        (None, None, "Other/Not Specified", "Other/Not Specified"),
        (None, "x in situ y", "FISH", "FISH"),
        ("IHC", "ERBB2", "Other/Not Specified", "IHC"),
        ("Chromogenic In Situ Hybridization", "ERBB2", "FISH", "FISH"),
    ],
)
def test_method(table, method, name, want, genetic):
    df = table("patient_test", test(method=method, name=name))
    assert her2.label_method(df).first().test_method == want
    assert her2.label_method(df, vocab.IHC_PATTERN_GENETIC).first().test_method == genetic


@pytest.mark.parametrize(
    "method, value, number, revised, current",
    [
        (IHC, "Negative", "1", "Low", "Low1+"),
        (IHC, "Negative", "2+", "Negative", "Low2+"),
        (IHC, "Negative", "1-2", "Negative", "Low1+"),
        (IHC, "Low", "1-2", "Low", "Low1+"),
        (IHC, "Not Recorded", "2", "Borderline", "Low2+"),
        (IHC, "Low", "2", "Low", "Low2+"),
        (IHC, "Equivocal", None, "Borderline", "Equivocal"),
        (IHC, "Equivocal", "2", "Equivocal", "Low2+"),
        (IHC, None, "1", "Unknown", "Low1+"),
        (IHC, "High", "3+", "Positive", "Positive"),
        (IHC, "Borderline", "2-3", "Borderline", "Low2+"),
        (IHC, "Indeterminate", "0", "Indeterminate", "Indeterminate"),
        ("FISH", "Borderline", "1", "Borderline", "Borderline"),
        ("FISH", "Wild Type", "1", "Negative", "Negative"),
        ("FISH", "Not performed", None, "Unknown", "Unknown"),
    ],
)
def test_result_rules(table, method, value, number, revised, current):
    df = her2.label_method(table("patient_test", test(method=method, value=value, number=number)))
    assert her2.clean_result(df, "revised").first().test_result == revised
    assert her2.clean_result(df, "current").first().test_result == current


@pytest.mark.parametrize(
    "number, want",
    [("2+", "2"), ("1-2", "1-2"), (None, "000-000-000"), ("+++", ""), ("+1+", "1"), ("+1", "+1"), ("1.0", "1.0")],
)
def test_number(table, number, want):
    df = her2.clean_numeric(table("patient_test", test(number=number)))
    assert df.first().test_value_numeric_cleaned == want


CHANGE_CASES = [
    ([("Negative", None), ("Negative", "1+")], {"change"}, {("Low", "none")}),
    ([("Negative", None), ("Negative", "1.0")], {"conflicting"}, {("Negative", "conflicting"), ("Low", "conflicting")}),
    ([("Negative", None), ("Negative", "0")], {"none"}, {("Negative", "none")}),
    (
        [("Negative", None), ("Negative", "0"), ("Negative", "1")],
        {"conflicting"},
        {("Negative", "conflicting"), ("Low", "conflicting")},
    ),
    ([("Positive", None), ("Negative", None)], {"conflicting"}, {("Positive", "conflicting"), ("Negative", "conflicting")}),
    ([("Negative", "1"), ("Negative", "1")], {"none"}, {("Low", "none")}),
]


@pytest.mark.parametrize("values, indicators, after", CHANGE_CASES)
def test_same_day(table, rows_of, values, indicators, after):
    df = table("patient_test", *[test(value=v, number=n) for v, n in values], test(patient=2, value="Negative"))
    df = her2.clean_numeric(her2.clean_result(her2.label_method(df)))
    judged = her2.same_day_indicator(df, "revised")
    assert {i for (i,) in rows_of(judged.where("patient_id = 1"), "sameday_ind")} == indicators
    assert rows_of(judged.where("patient_id = 2"), "sameday_ind") == {("none",)}
    assert judged.count() == len(values) + 1
    changed = her2.apply_change(judged, "revised")
    assert rows_of(changed.where("patient_id = 1"), "test_result", "sameday_ind") == after


def test_same_day_current_rules(table, rows_of):
    df = table("patient_test", test(value="Negative"), test(value="Negative", number="1"))
    assert rows_of(her2.label_tests(df, "current"), "test_result", "sameday_ind") == {("Low1+", "none")}


def test_same_day_groups_join_on_missing_keys(table, rows_of):
    rows = [test(day=None, method=None, name="immuno", value=v) for v in ("Positive", "Negative")]
    df = table("patient_test", *rows)
    assert rows_of(her2.label_tests(df), "sameday_ind") == {("conflicting",)}
    assert her2.settled_tests(df).count() == 0


def test_genetic_union_merges_copies_and_reads_both_results(table, rows_of):
    tests = table("patient_test", test(value="Negative"), test(value="Negative"))
    genetic = table(
        "genetic_test",
        dict(patient_id=2, report_date="2000-01-01", biomarker_name="ERBB2", biomarker_test_type="IHC",
             test_result="Negative", test_result_1_numeric="1", test_result_1_unit="Staining Intensity (+)",
             test_result_2_numeric="2.0", test_result_2_unit="ERBB2:CEP17"),
        dict(patient_id=3, biomarker_name="ERBB2", biomarker_test_type="NGS", test_result_1_unit="ERBB2:CEP17"),
        dict(patient_id=4, biomarker_name="ERBB2", biomarker_test_type="FISH", test_result_1_unit="percent"),
    )
    df = her2.her2_label_with_genetic(tests, genetic)
    assert df.count() == 3
    # The two genetic results disagree on one day, so both are flagged.
    assert rows_of(df.where("patient_id = 2"), "test_value_numeric", "test_method", "test_result", "sameday_ind") == {
        ("1", "IHC", "Low", "conflicting"), ("2.0", "IHC", "Negative", "conflicting"),
    }


def test_merged_labels_equal_row_labels_for_any_number(table, rows_of):
    rng = random.Random(5)
    numbers = [None, None, "1", "1", "1+", "0", "2", "1++", "+1+", "+", "0.4", "01", "12.5", "000-000-000", "00", "x", "1.5+"]
    tests = table(
        "patient_test",
        *[
            test(day=f"2000-01-{1 + i // 3 % 28:02d}", name=f"HER2 {i // 84}", number=rng.choice(numbers),
                 value=rng.choice(["Negative", "Negative", "Negative", "Low", None, "Equivocal"]))
            for i in range(1500)
        ],
    )
    for ruleset in vocab.RULESETS:
        by_row = her2.label_tests(tests, ruleset)
        merged = her2.label_merged(tests, ruleset)
        columns = ("test_date", "test_name_name", "test_value_name", "test_result", "sameday_ind")
        want = Counter(tuple(r) for r in by_row.select(*columns).collect())
        got = Counter()
        for r in merged.select(*columns, "n_rows").collect():
            got[tuple(r)[:-1]] += r.n_rows
        assert got == want
        assert len({r[-1] for r in want}) > 1
        usable = her2.nearest_fish_for_ihc(by_row).collect()
        settled = her2.match_settled(her2.settled_tests(tests, ruleset)).collect()
        assert usable and Counter(usable) == Counter(settled)
        known = {n for (n,) in rows_of(merged, "test_value_numeric")}
        assert known <= {None, *vocab.KNOWN_NUMERICS, "00", "01", "1++", "9", "000-000-000"}


def labelled(table, *rows):
    return her2.label_tests(table("patient_test", *rows))


def fish(day, value="Negative", number=None, patient=1):
    return test(patient=patient, day=day, method="FISH", name="ERBB2 gene", value=value, number=number)


def pairs(df):
    return sorted(
        (str(r.ihc_test_date), r.fish_test_date and str(r.fish_test_date), r.fish_test_result, r.datediffer, r.n_rows)
        for r in df.collect()
    )


def test_nearest_fish_keeps_ties(table):
    df = labelled(table, test(day="2000-01-10", value="Negative"), fish("2000-01-07"), fish("2000-01-13"), fish("2000-01-20"))
    assert pairs(her2.nearest_fish_for_ihc(df)) == [
        ("2000-01-10", "2000-01-07", "Negative", -3, 1),
        ("2000-01-10", "2000-01-13", "Negative", 3, 1),
    ]
    assert pairs(her2.nearest_fish_for_ihc(df, window_days=(-2, 5))) == [("2000-01-10", "2000-01-13", "Negative", 3, 1)]


@pytest.mark.parametrize(
    "others, want",
    [
        ([fish(None, "Positive"), fish("2000-03-01")], [("2000-01-10", "2000-03-01", "Negative", 51, 1)]),
        ([fish(None, "Positive")], [("2000-01-10", None, "Positive", None, 1)]),
        ([], [("2000-01-10", None, None, None, 1)]),
        ([fish("2000-01-10"), fish("2000-01-10")], [("2000-01-10", "2000-01-10", "Negative", 0, 2)]),
        ([fish("2000-01-10", number="4")], [("2000-01-10", None, None, None, 1)]),
        ([fish("2000-01-11", patient=2)], [("2000-01-10", None, None, None, 1)]),
    ],
)
def test_nearest_fish_missing_and_repeated(table, others, want):
    df = labelled(table, test(day="2000-01-10", value="Negative"), *others)
    assert pairs(her2.nearest_fish_for_ihc(df)) == want


def test_nearest_fish_leaves_out_conflicts_and_undated(table):
    df = labelled(
        table, test(value="Positive"), test(value="Negative"), test(day=None, value="Negative"), fish("2000-01-02")
    )
    assert pairs(her2.nearest_fish_for_ihc(df)) == []


def test_er_pr_labels(table, rows_of):
    tests = table(
        "patient_test",
        test(1, code="3467", method="immunohisto", value="Wild Type", number="+1+"),
        test(2, code="3467", method="immunoassay", value="Positive"),
        test(3, code="16113-3", method=None, name="Progesterone receptor", value="Indeterminate"),
        test(4, code="x", method="Immunoassay", name="HORMONE RECEPTOR", value="Equivocal"),
    )
    condition = table(
        "condition",
        dict(patient_id=5, diagnosis_code_code="z17.1", diagnosis_code_name="ER NEGATIVE", diagnosis_date="2000-01-01"),
        dict(patient_id=6, diagnosis_code_code="Z17.9", diagnosis_code_name="ER status", diagnosis_date="2000-01-01"),
    )
    columns = ("patient_id", "biomarker", "test_method", "test_result", "test_value_numeric_cleaned")
    assert rows_of(receptor.er_pr_label(tests, condition), *columns) == {
        (1, "ER", "IHC", "Negative", "1"),
        (3, "PR", "Not Specified", "Unknown", None),
        (4, "ER/PR", "IHC", "Equivocal", None),
        (5, "ER", "IHC", "Negative", None),
        (6, "ER", "IHC", None, None),
    }


def test_genetic_er_pr_keep_the_label_gap_unless_asked(table, rows_of):
    genetic = table(
        "genetic_test",
        dict(patient_id=1, biomarker_name="ESR1", biomarker_test_type="IHC", test_result="Positive"),
        dict(patient_id=2, biomarker_name="PGR", biomarker_test_type="ICC", test_result="Negative"),
        dict(patient_id=3, biomarker_name="PGR", biomarker_test_type="ihc", test_result="Negative"),
    )
    condition = table(
        "condition", dict(patient_id=4, diagnosis_code_code="Z17.0", diagnosis_code_name="positive")
    )
    clinical = table("patient_test", test(9, code="none"))
    columns = ("patient_id", "biomarker", "test_method", "test_result")
    base = {(1, "ER", "Positive"), (2, "PR", "Negative"), (4, "ER", "Positive")}
    for fix, method in ((False, "Other/Not Specified"), (True, "IHC")):
        df = receptor.er_pr_label_with_genetic(clinical, genetic, condition, fix_ihc_label=fix)
        assert rows_of(df, *columns) == {(p, b, method, r) for p, b, r in base}


def test_conflicting_receptor_groups_go_whole(frame, rows_of):
    df = frame(
        "patient_id bigint, test_date date, test_name_name string, test_method_name string, test_result string",
        (1, "2000-01-01", None, None, "Positive"),
        (1, "2000-01-01", None, None, "Negative"),
        (1, "2000-01-01", "ER", None, "Negative"),
        (2, None, "ER", "x", "Negative"),
        (2, None, "ER", "x", None),
    )
    kept = rows_of(receptor.drop_same_day_conflicts(df), "patient_id", "test_name_name", "test_result")
    assert kept == {(1, "ER", "Negative"), (2, "ER", "Negative"), (2, "ER", None)}
    labelled = df.selectExpr("*", "'ER' AS biomarker", "'IHC' AS test_method")
    settled = rows_of(receptor.settled_receptors(labelled), "patient_id", "test_result")
    assert settled == {(1, "Negative"), (2, "Negative"), (2, None)}


RECEPTOR = "patient_id bigint, biomarker string, test_result string, test_date date, test_method string"


def wide(frame, *rows):
    onset = frame("patient_id bigint, met_date date", *{(r[0], "2000-01-10") for r in rows})
    return receptor.receptor_wide(receptor.nearest_test_to_onset(frame(RECEPTOR, *rows), onset))


def test_ties_are_settled_by_the_largest_text(frame, rows_of):
    got = wide(
        frame,
        (1, "ER", "Positive", "2000-01-08", "IHC"),
        (1, "ER", "Unknown", "2000-01-12", "IHC"),
        (1, "ER", "Negative", "2000-01-13", "IHC"),
        (2, "HER2", "Borderline", "2000-01-09", "IHC"),
        (2, "HER2", "Low", "2000-01-11", "IHC"),
    )
    assert rows_of(got, "patient_id", "er", "her2_ihc", "hr_status") == {
        (1, "Unknown", None, None), (2, None, "Low", None),
    }


@pytest.mark.parametrize(
    "results, status",
    [
        ({"ER": "Negative"}, None),
        ({"ER": "Negative", "PR": "Negative"}, "Negative"),
        ({"ER": "Positive", "ER/PR": "Negative"}, "Positive"),
        ({"ER/PR": "Negative"}, "Negative"),
        ({"ER": "Unknown", "PR": "Negative"}, None),
        ({"PR": "Positive"}, "Positive"),
    ],
)
def test_hr_status(frame, results, status):
    got = wide(frame, *[(1, marker, result, "2000-01-10", "IHC") for marker, result in results.items()])
    assert got.first().hr_status == status


def test_other_methods_and_undated_tests_stay_out(frame):
    got = wide(frame, (1, "ER", "Positive", "2000-01-10", "Other/Not Specified"), (1, "PR", "Positive", None, "IHC"))
    assert got.count() == 0


def test_report_conditions(frame):
    rows = [
        ("Positive", "Borderline", "Negative"),
        ("Positive", "Borderline", None),
        ("Positive", "Low", "Negative"),
        ("Positive", "Low", None),
        ("Positive", "Low", "Positive"),
        ("Positive", "Negative", "Positive"),
        ("Positive", None, "Negative"),
        ("Negative", "Borderline", "Negative"),
        ("Negative", "Low", None),
        ("Negative", "Negative", None),
        (None, "Negative", "Negative"),
    ]
    df = frame(
        "patient_id bigint, hr_status string, her2_ihc string, her2_fish string",
        *[(i, *row) for i, row in enumerate(rows)],
    )
    assert reports.receptor_report(df).first().asDict() == {
        "hr_pos_borderline_fish_negative": 1,
        "hr_pos_borderline_fish_negative_or_missing": 2,
        "hr_pos_low_fish_negative": 2,
        "hr_pos_low_fish_negative_or_missing": 4,
        "hr_neg_borderline_fish_negative": 1,
        "hr_neg_borderline_fish_negative_or_missing": 1,
        "hr_neg_low_fish_negative": 1,
        "hr_neg_low_fish_negative_or_missing": 2,
        "hr_pos_her2_negative": 2,
        "triple_negative": 1,
    }
    strict = count_patients(df, n=reports.hr("Positive") & reports.strict_her2_negative()).first().n
    assert strict == 1
    assert reports.receptor_report(df.where(F.lit(False))).first().triple_negative == 0
