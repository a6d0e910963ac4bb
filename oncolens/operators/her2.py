"""HER2 labelling: method, result, number, same-day reconciliation, FISH matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oncolens.functions import vocab
from oncolens.functions.columns import all_of, day_diff, drop_plus, ends_with_plus, first_match, one_of
from oncolens.functions.patterns import similar_to
from oncolens.operators.grouping import Flags, by_patient, flag_groups, judge_groups, merge_copies
from oncolens.operators.nearest import match_nearest
from oncolens.operators.windowed import her2_test_filter

SAME_DAY = ("patient_id", "test_date", "test_name_name", "test_method_name")

CLINICAL_COLUMNS = (
    "patient_id", "test_name_code", "test_date", "test_collection_date", "test_method_name", "test_name_name",
    "test_value_name", "test_value_numeric", "test_unit_name", "curation_indicator",
)
GENETIC_COLUMNS = (
    "patient_id", "test_date", "biomarker", "test_collection_date", "test_method_name", "test_name_name",
    "test_value_name", "test_value_numeric", "test_unit_name",
)


def method_mentions(pattern: str) -> Column:
    """The method, or failing that the test's own name, is similar to the pattern."""
    return similar_to(F.lower("test_method_name"), pattern) | similar_to(F.lower("test_name_name"), pattern)


def label_method(tests: DataFrame, ihc_pattern: str = vocab.IHC_PATTERN) -> DataFrame:
    """Adds test_method; IHC wins where both are mentioned."""
    method = first_match(
        [(method_mentions(ihc_pattern), "IHC"), (method_mentions(vocab.FISH_PATTERN), "FISH")],
        otherwise=vocab.OTHER_METHOD,
    )
    return tests.withColumn("test_method", method)


def _rule_holds(rule: vocab.ResultRule) -> Column:
    name, numeric = F.col("test_value_name"), F.col("test_value_numeric")
    parts = []
    if rule.ihc_only:
        parts.append(F.col("test_method") == "IHC")
    if rule.names:
        named = one_of("test_value_name", rule.names)
        parts.append(named | name.isNull() if rule.name_may_be_missing else named)
    if rule.numerics:
        parts.append(one_of("test_value_numeric", rule.numerics))
    if rule.numeric_missing:
        parts.append(numeric.isNull())
    return all_of(parts)


def clean_result(tests: DataFrame, ruleset: str = "revised") -> DataFrame:
    """Adds test_result by the ruleset's ordered rules, else the raw name."""
    rules = [(_rule_holds(rule), rule.label) for rule in vocab.RULESETS[ruleset].rules]
    return tests.withColumn("test_result", first_match(rules, otherwise=F.col("test_value_name")))


def clean_numeric(tests: DataFrame) -> DataFrame:
    """Adds test_value_numeric_cleaned: plus signs off, a sentinel for missing."""
    numeric = F.col("test_value_numeric")
    cleaned = first_match(
        [(ends_with_plus(numeric), drop_plus(numeric)), (numeric.isNull(), vocab.NUMERIC_MISSING)],
        otherwise=numeric,
    )
    return tests.withColumn("test_value_numeric_cleaned", cleaned)


SAME_DAY_SPANS = {"name": "test_value_name", "result": "test_result", "number": "test_value_numeric_cleaned"}


def _same_day_flags(ruleset: str) -> Flags:
    settled = vocab.RULESETS[ruleset].settled

    def judge(low, high):
        one_name = low["name"] == high["name"]
        all_settled = low["result"].isin(*settled) & high["result"].isin(*settled)
        missing_or_one = (low["number"] == vocab.NUMERIC_MISSING) & (high["number"] == "1")
        return {"may_change": one_name & all_settled & missing_or_one, "conflicts": low["result"] != high["result"]}

    return judge


def _with_indicator(judged: DataFrame) -> DataFrame:
    indicator = first_match(
        [((F.col("test_method") == "IHC") & F.col("may_change"), "change"), (F.col("conflicts"), "conflicting")],
        otherwise="none",
    )
    return judged.withColumn("sameday_ind", indicator).drop("may_change", "conflicts")


def same_day_indicator(tests: DataFrame, ruleset: str = "revised") -> DataFrame:
    """Adds sameday_ind: change, conflicting or none for tests repeated on one day.

    ``change`` marks one value name, results within {low, Negative}, and scores that
    are missing or '1' with both present. (The mirrored score test, smallest '1' and
    largest the sentinel, cannot hold: the sentinel sorts first.)
    """
    return _with_indicator(flag_groups(tests, SAME_DAY, SAME_DAY_SPANS, _same_day_flags(ruleset)))


def apply_change(tests: DataFrame, ruleset: str = "revised") -> DataFrame:
    """Rows marked change become the ruleset's low result; both columns see old values."""
    changed = F.col("sameday_ind") == "change"
    return tests.withColumns(
        {
            "test_result": F.when(changed, vocab.RULESETS[ruleset].low).otherwise(F.col("test_result")),
            "sameday_ind": F.when(changed, "none").otherwise(F.col("sameday_ind")),
        }
    )


def _cleaned(tests: DataFrame, ruleset: str, ihc_pattern: Sequence[str]) -> DataFrame:
    return clean_numeric(clean_result(label_method(tests, ihc_pattern), ruleset))


def label_tests(
    tests: DataFrame, ruleset: str = "revised", ihc_pattern: str = vocab.IHC_PATTERN
) -> DataFrame:
    """Every labelling step on tests already selected; other columns pass through."""
    return apply_change(same_day_indicator(_cleaned(tests, ruleset, ihc_pattern), ruleset), ruleset)


def bound_numeric(tests: DataFrame) -> DataFrame:
    """Free-text numbers replaced by a stand-in that labels and filters treat alike.

    No rule names them; all that matters is how the cleaned text sorts against the
    sentinel and '1' in the same-day test, and that no score list holds it.
    """
    numeric = F.col("test_value_numeric")
    cleaned = F.when(ends_with_plus(numeric), drop_plus(numeric)).otherwise(numeric)
    stand_in = first_match(
        [
            (numeric.isNull() | one_of("test_value_numeric", vocab.KNOWN_NUMERICS), numeric),
            (cleaned < vocab.NUMERIC_MISSING, "00"),
            (cleaned == vocab.NUMERIC_MISSING, vocab.NUMERIC_MISSING),
            (cleaned < "1", "01"),
            (cleaned == "1", "1++"),
        ],
        otherwise=F.lit("9"),
    )
    return tests.withColumn("test_value_numeric", stand_in)


def label_merged(
    tests: DataFrame, ruleset: str = "revised", ihc_pattern: str = vocab.IHC_PATTERN
) -> DataFrame:
    """The labels of ``label_tests`` on merged rows, for analyses that do not list tests.

    Only the columns the labels depend on are kept, unlisted numbers are bounded, copies
    are merged first, and ``n_rows`` says how many tests a row stands for. No step places
    a patient's rows together.
    """
    merged = merge_copies(bound_numeric(tests), *SAME_DAY, "test_value_name", "test_value_numeric")
    return label_tests(merged, ruleset, ihc_pattern)


MATCHED_BY = ("patient_id", "test_date", "test_method", "test_result")


def _clean_score() -> Column:
    method, numeric = F.col("test_method"), F.col("test_value_numeric")
    return ((method == "IHC") & (numeric.isNull() | one_of("test_value_numeric", vocab.IHC_SCORES))) | (
        (method == "FISH") & (numeric.isNull() | one_of("test_value_numeric", vocab.FISH_SCORES))
    )


def _flags_by_ruleset(rulesets: Sequence[str]) -> Flags:
    """The same-day flags of each ruleset, from spans that hold a result per ruleset."""

    def judge(low, high):
        flags = {}
        for r in rulesets:
            own = [{**span, "result": span[f"result_{r}"]} for span in (low, high)]
            flags |= {f"{name}_{r}": flag for name, flag in _same_day_flags(r)(*own).items()}
        return flags

    return judge


def settled_by_ruleset(
    tests: DataFrame, rulesets: Sequence[str], ihc_pattern: str = vocab.IHC_PATTERN
) -> DataFrame:
    """``settled_tests`` of several rulesets from one pass, with ``ruleset``.

    Each test gets a result per ruleset and stays one row; the group's aggregate judges
    them side by side. Only what is settled, a few rows per group, is unfolded.
    """
    labelled = label_method(tests, ihc_pattern).where(one_of("test_method", ("IHC", "FISH")))
    for r in rulesets:
        labelled = clean_result(labelled, r).withColumnRenamed("test_result", f"test_result_{r}")
    clean = _clean_score()
    named = {f"n_named_{r}": F.count_if(clean & F.col(f"test_result_{r}").isNotNull()) for r in rulesets}
    judged = judge_groups(
        clean_numeric(labelled),
        (*SAME_DAY, "test_method"),
        {k: c for k, c in SAME_DAY_SPANS.items() if k != "result"} | {f"result_{r}": f"test_result_{r}" for r in rulesets},
        _flags_by_ruleset(rulesets),
        n_clean=F.count_if(clean),
        **named,
    )

    def readings(r: str) -> Column:
        def reading(result: Column, n: Column) -> Column:
            return F.struct(F.lit(r).alias("ruleset"), result.cast("string").alias("test_result"), n.alias("n_rows"))

        n, n_named = F.col("n_clean"), F.col(f"n_named_{r}")
        as_found = F.array(reading(F.col(f"min_result_{r}"), n_named), reading(F.lit(None), n - n_named))
        changed = F.array(reading(F.lit(vocab.RULESETS[r].low), n))
        return F.when((F.col("test_method") == "IHC") & F.col(f"may_change_{r}"), changed).when(
            ~F.col(f"conflicts_{r}"), as_found
        )

    found = F.flatten(F.array_compact(F.array(*[readings(r) for r in rulesets])))
    settled = judged.select("patient_id", "test_date", "test_method", F.inline(found)).where("n_rows > 0")
    return merge_copies(settled, "ruleset", *MATCHED_BY)


def settled_tests(
    tests: DataFrame, ruleset: str = "revised", ihc_pattern: str = vocab.IHC_PATTERN
) -> DataFrame:
    """The tests that take part in FISH matching, merged to MATCHED_BY with ``n_rows``.

    Equal to the rows of ``label_tests`` without a same-day flag and with a clean score.
    What a group of a day, name and method holds once it does not conflict is one result
    and missing ones, so an aggregate that combines map-side is the whole judgement and
    no test is joined back or sorted.
    """
    return settled_by_ruleset(tests, (ruleset,), ihc_pattern).drop("ruleset")


def her2_label(patient_test: DataFrame, ruleset: str = "revised") -> DataFrame:
    """HER2 tests of the clinical table, labelled; repeated rows are kept."""
    return label_tests(her2_test_filter(patient_test).select(*CLINICAL_COLUMNS), ruleset)


def her2_tests_with_genetic(patient_test: DataFrame, genetic_test: DataFrame) -> DataFrame:
    """Distinct HER2 rows of the clinical table and of both genetic results.

    A genetic row is read once and unfolded into its two results.
    """
    clinical = her2_test_filter(patient_test).withColumn("biomarker", F.lit("HER2")).select(*GENETIC_COLUMNS)
    readings = F.array(
        *[
            F.struct(
                F.col(f"test_result_{i}_numeric").alias("test_value_numeric"),
                F.col(f"test_result_{i}_unit").alias("test_unit_name"),
            )
            for i in (1, 2)
        ]
    )
    genetic = (
        genetic_test.where(
            (F.col("biomarker_name") == "ERBB2")
            & similar_to(F.lower("biomarker_test_type"), vocab.GENETIC_HER2_METHODS)
        )
        .select(
            "patient_id",
            F.col("report_date").alias("test_date"),
            F.lit("HER2").alias("biomarker"),
            F.col("specimen_collected_date").alias("test_collection_date"),
            F.col("biomarker_test_type").alias("test_method_name"),
            F.col("biomarker_name").alias("test_name_name"),
            F.col("test_result").alias("test_value_name"),
            F.inline(readings),
        )
        .where(one_of("test_unit_name", vocab.GENETIC_HER2_UNITS))
    )
    return clinical.union(genetic.select(*GENETIC_COLUMNS)).distinct()


def her2_label_with_genetic(patient_test: DataFrame, genetic_test: DataFrame) -> DataFrame:
    return label_tests(
        her2_tests_with_genetic(patient_test, genetic_test), "revised", vocab.IHC_PATTERN_GENETIC
    )


def nearest_fish_for_ihc(labelled: DataFrame, window_days: tuple[int, int] | None = None) -> DataFrame:
    """Each dated IHC test with the FISH test(s) nearest to it, before or after.

    Takes labelled rows or merged ones. Tests with a same-day flag or an unclean score
    take no part; the rest is ``match_settled``.
    """
    usable = labelled.where(_clean_score() & (F.col("sameday_ind") == "none"))
    return match_settled(merge_copies(usable, *MATCHED_BY), window_days)


def match_settled(
    settled: DataFrame,
    window_days: tuple[int, int] | None = None,
    by: Sequence[str] = (),
    placed: bool = False,
) -> DataFrame:
    """The matching itself, on distinct MATCHED_BY rows with ``n_rows``; apart for each value of ``by``.

    Ties are kept; undated FISH counts only for patients without a dated one; an IHC test
    of a patient without FISH stays with empty FISH columns.

    Copies of a test would multiply with copies of its match, so equal result rows
    come once with their number in ``n_rows``; ``repeat_rows`` writes them out.
    """
    method, value = F.col("test_method"), F.struct("test_result", "n_rows")
    # One entry per distinct result of a patient's day.
    days = by_patient(settled, placed).groupBy(*by, "patient_id", F.col("test_date").alias("day")).agg(
        *[F.collect_list(F.when(method == kind, value)).alias(kind.lower()) for kind in ("IHC", "FISH")]
    )
    out = match_nearest(days, "ihc", "fish", by).select(
        *by,
        "patient_id",
        F.col("day").alias("ihc_test_date"),
        F.col("ihc.test_result").alias("ihc_test_result"),
        F.lit("IHC").alias("ihc_test_method"),
        F.col("right_day").alias("fish_test_date"),
        F.col("fish.test_result").alias("fish_test_result"),
        F.when(F.col("fish").isNotNull(), "FISH").alias("fish_test_method"),
        day_diff(F.col("day"), F.col("right_day")).alias("datediffer"),
        F.lit(1).alias("closest_test"),
        (F.col("ihc.n_rows") * F.coalesce("fish.n_rows", F.lit(1))).alias("n_rows"),
    )
    return out if window_days is None else out.where(F.col("datediffer").between(*window_days))
