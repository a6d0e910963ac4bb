"""RAS variants: normalisation, co-mutation scores, co-amplification rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oncolens.functions import vocab
from oncolens.functions.columns import first_match, matches, one_of, percent
from oncolens.operators.grouping import dense_rank_values, join_groups

RANK_KEYS = ("patient_id", "biomarker_name_name", "biomarker_variant_type_name")


def normalise_variant(variant: Column, variant_type: Column) -> Column:
    """One spelling per protein change; unknown spellings stay as they are."""
    rules = [(matches(variant, pattern), label) for pattern, label in vocab.VARIANT_PATTERNS]
    rules.append((matches(variant, vocab.EXON_PATTERN) & ~matches(variant, vocab.EXON_EXCLUDES), vocab.EXON_LABEL))
    rules += [
        (variant.isNull() & (variant_type == kind), label) for kind, label in vocab.MISSING_VARIANT_LABELS.items()
    ]
    return first_match(rules, otherwise=variant)


def with_variant(biomarker: DataFrame) -> DataFrame:
    return biomarker.withColumn(
        "variant", normalise_variant(F.col("molecular_variant"), F.col("biomarker_variant_type_name"))
    )


def relevant_class() -> Column:
    """Unclassified, or classified as neither benign nor uncertain."""
    kind = F.col("variant_classification_name")
    return kind.isNull() | ~matches(kind, vocab.HARMLESS_CLASSES)


def _ras_rows(biomarker: DataFrame) -> DataFrame:
    chosen = biomarker.where(
        F.col("biomarker_name_name").ilike("%ras")
        & one_of("test_result_name", vocab.RAS_RESULTS)
        & one_of("biomarker_variant_type_name", vocab.RAS_VARIANT_TYPES)
        & relevant_class()
    )
    return with_variant(chosen).select(*RANK_KEYS, "report_date", "variant")


def ras_variant_ranks(biomarker: DataFrame, cells: int = 1) -> DataFrame:
    """Distinct variants per patient, gene and type with their dense rank; ``cells`` as in ``dense_rank_values``."""
    return dense_rank_values(_ras_rows(biomarker), RANK_KEYS, "variant", "rank_variant_types", cells)


def ras_mutations(biomarker: DataFrame, cells: int = 1) -> DataFrame:
    """Every qualifying RAS result row with its normalised variant and that variant's rank.

    Distinct variants are ranked and the rank joined back, so a patient with very many
    rows is not sorted in one task; nor, with ``cells``, one with very many variants.
    """
    rows = _ras_rows(biomarker)
    ranks = dense_rank_values(rows, RANK_KEYS, "variant", "rank_variant_types", cells)
    return join_groups(rows, ranks, (*RANK_KEYS, "variant"), "inner")


def ras_correct_counts(ranks: DataFrame) -> DataFrame:
    """Distinct patient, gene and variant with the mutations each counts for.

    Takes the output of ``ras_mutations`` or, shorter, of ``ras_variant_ranks``.
    Patients without a second rank count 1 per row. For the others a missing variant at
    rank 2 counts 0, any rank beyond 2 counts 1 (the condition is lost in the source
    script, whose note says so), a named variant at rank 1 or 2 counts 1, and a missing
    variant alone at rank 1 counts null.
    """
    ranks = ranks.select(*RANK_KEYS, "variant", "rank_variant_types").distinct()
    patient = Window.partitionBy("patient_id")
    rank, named = F.col("rank_variant_types"), F.col("variant").isNotNull()
    score = first_match(
        [
            (F.col("top_rank") <= 1, F.lit(1)),
            (~named & (rank == 2), F.lit(0)),
            (rank > 2, F.lit(1)),
            (named & rank.isin(1, 2), F.lit(1)),
        ]
    )
    return (
        ranks.withColumn("top_rank", F.max("rank_variant_types").over(patient))
        .select("patient_id", "biomarker_name_name", "variant", score.alias("correct_tab"))
        .distinct()
    )


def ras_secondary_percent(ranks: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Percent of RAS-mutant patients whose counted mutations add up to more than one."""
    counts = ras_correct_counts(ranks) if counts is None else counts
    # Every ranked patient has at least one counted row, so both numbers come from one pass.
    per_patient = counts.where(F.col("patient_id").isNotNull()).groupBy("patient_id").agg(
        F.sum("correct_tab").alias("mutations")
    )
    return per_patient.agg(
        percent(F.count(F.when(F.col("mutations") > 1, 1)), F.count("*")).alias("percent_secondary")
    )


def _kras_mutant() -> Column:
    return (
        (F.col("biomarker_name_name") == "KRAS")
        & (F.col("biomarker_variant_type_name") == "Gene Mutation")
        & one_of("test_result_name", vocab.RAS_RESULTS)
        & relevant_class()
    )


def _amplified(gene: Column) -> Column:
    return (
        gene
        & one_of("test_result_name", vocab.AMPLIFIED_RESULTS)
        & (F.col("biomarker_variant_type_name") == "Gene Amplification")
    )


def _any_ras_amplified() -> Column:
    return _amplified(F.col("biomarker_name_name").like("%RAS"))


def _kras_amplified() -> Column:
    return _amplified(F.col("biomarker_name_name") == "KRAS")


def _kras_not_amplified() -> Column:
    return (
        (F.col("biomarker_name_name") == "KRAS")
        & (F.col("test_result_name") == "Negative")
        & one_of("biomarker_variant_type_name", vocab.COPY_NUMBER_TYPES)
    )


def _flag(condition: Column) -> Column:
    return F.max(F.when(condition, 1).otherwise(0)) == 1


def _patient_flags(biomarker: DataFrame, **conditions: Column) -> DataFrame:
    """One row per patient with a flag per condition, from a single read."""
    any_condition = None
    for condition in conditions.values():
        any_condition = condition if any_condition is None else any_condition | condition
    return (
        biomarker.where(any_condition & F.col("patient_id").isNotNull())
        .groupBy("patient_id")
        .agg(*[_flag(condition).alias(name) for name, condition in conditions.items()])
    )


def _variant_counts(biomarker: DataFrame, where: Column, **conditions: Column) -> DataFrame:
    """KRAS mutants counted per variant, where their patients' flags say so, from a single read.

    Rows are merged to (patient, variant) before the window gives each what any row of
    its patient has.
    """
    any_condition = _kras_mutant()
    for condition in conditions.values():
        any_condition = any_condition | condition
    rows = with_variant(biomarker.where(any_condition & F.col("patient_id").isNotNull()))
    flags = [_flag(condition).alias(name) for name, condition in conditions.items()]
    merged = rows.groupBy("patient_id", "variant").agg(_flag(_kras_mutant()).alias("mutant"), *flags)
    patient = Window.partitionBy("patient_id")
    known = merged.withColumns({name: F.max(name).over(patient) for name in conditions})
    return known.where(F.col("mutant") & where).groupBy("variant").agg(F.count("*").alias("n"))


def kras_coamplified_by_variant(biomarker: DataFrame) -> DataFrame:
    """KRAS-mutant patients with any amplified RAS gene, per variant."""
    return _variant_counts(biomarker, F.col("amplified"), amplified=_any_ras_amplified())


def kras_coamplified_percent(biomarker: DataFrame) -> DataFrame:
    flags = _patient_flags(biomarker, mutant=_kras_mutant(), amplified=_any_ras_amplified())
    return flags.agg(
        percent(
            F.count(F.when(F.col("mutant") & F.col("amplified"), 1)), F.count(F.when(F.col("mutant"), 1))
        ).alias("percent_coamplified")
    )


def kras_wt_amp_by_variant(biomarker: DataFrame) -> DataFrame:
    """KRAS-mutant patients tested for amplification and only ever negative, per variant."""
    wild_type = F.col("negative") & ~F.col("positive")
    return _variant_counts(biomarker, wild_type, negative=_kras_not_amplified(), positive=_kras_amplified())


def kras_wt_amp_percent(biomarker: DataFrame) -> DataFrame:
    flags = _patient_flags(
        biomarker, mutant=_kras_mutant(), negative=_kras_not_amplified(), positive=_kras_amplified()
    )
    wild_type = F.col("mutant") & F.col("negative") & ~F.col("positive")
    return flags.agg(
        percent(F.count(F.when(wild_type, 1)), F.count(F.when(F.col("mutant"), 1))).alias("percent_wild_type")
    )
