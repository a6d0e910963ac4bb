"""Hand-checked rows for the RAS analyses."""

from __future__ import annotations

import pytest

from oncolens.operators import ras


def row(patient, variant, kind="Gene Mutation", gene="KRAS", result="Positive", cls=None):
    return dict(
        patient_id=patient, biomarker_name_name=gene, biomarker_variant_type_name=kind, test_result_name=result,
        molecular_variant=variant, variant_classification_name=cls,
    )


@pytest.mark.parametrize(
    "variant, kind, want",
    [
        ("exon 20", "Gene Mutation", "Exon 2"),
        ("exon2 G12", "Gene Mutation", "exon2 G12"),
        ("c.176C>A;p.A59E", "Gene Mutation", "c.176C>A;p.A59E"),
        (None, "Gene Amplification", "GeneAmp"),
        (None, "Gene Rearrangement Abnormality", "GeneRearrang"),
        (None, "Gene Mutation", None),
        ("c.135G>A", "Gene Mutation", "p.G12D"),
        ("183A>C", "Gene Mutation", "p.Q61H"),
        ("p.g12v", "Gene Mutation", "p.G12V"),
        ("cX35G>C", "Gene Mutation", "p.G12A"),
        ("G12D G12V", "Gene Mutation", "p.G12D"),
        ("p.Q16R", "Gene Mutation", "p.Q61R"),
    ],
)
def test_normalise(table, variant, kind, want):
    assert ras.with_variant(table("biomarker_table", row(1, variant, kind))).first().variant == want


def test_mutation_filters(table, rows_of):
    df = table(
        "biomarker_table",
        row(1, "G12D", gene="kras"), row(2, "G12D", gene="TP53"), row(3, "G12D", result="Negative"),
        row(4, "G12D", kind="Wild Type"), row(5, "G12D", cls="Likely BENIGN"), row(6, "G12D", cls="Pathogenic"),
        row(7, "G12D", gene="NRAS", result="Equivocal"),
    )
    assert rows_of(ras.ras_mutations(df), "patient_id") == {(1,), (6,), (7,)}


def test_ranks_put_missing_last_and_keep_copies(table):
    df = table("biomarker_table", row(1, None), row(1, "T58I"), row(1, "G12D"), row(1, "c.35G>A"), row(1, None))
    got = sorted((str(r.variant), r.rank_variant_types) for r in ras.ras_mutations(df).collect())
    assert got == [("None", 3), ("None", 3), ("p.G12D", 1), ("p.G12D", 1), ("p.T58I", 2)]


@pytest.mark.parametrize(
    "variants, total", [(["G12D", None], 1), (["G12D", "c.35G>T"], 2), ([None], 1), (["G12D", "G12V", "T58I"], 3)]
)
@pytest.mark.parametrize("ranks", [ras.ras_mutations, ras.ras_variant_ranks])
def test_correct_counts(table, variants, total, ranks):
    df = table("biomarker_table", *[row(1, v) for v in variants])
    assert sum(r.correct_tab or 0 for r in ras.ras_correct_counts(ranks(df)).collect()) == total


def test_missing_variant_of_a_second_gene_counts_null(table, rows_of):
    df = table("biomarker_table", row(1, "G12D"), row(1, "G12V"), row(1, None, gene="NRAS"))
    counts = ras.ras_correct_counts(ras.ras_mutations(df))
    assert rows_of(counts, "biomarker_name_name", "variant", "correct_tab") == {
        ("KRAS", "p.G12D", 1), ("KRAS", "p.G12V", 1), ("NRAS", None, None),
    }


def test_secondary_percent(table):
    df = table(
        "biomarker_table", row(1, "G12D"), row(1, "G12V"), row(2, "G12D"), row(3, None), row(4, "G12D"),
        row(4, "Q61K", gene="NRAS"),
    )
    ranks = ras.ras_variant_ranks(df)
    assert ras.ras_secondary_percent(ranks).first().percent_secondary == 50.0
    assert ras.ras_secondary_percent(ranks.where("patient_id > 9")).first().percent_secondary is None


def test_coamplification(table, rows_of):
    amp = "Gene Amplification"
    df = table(
        "biomarker_table",
        row(1, "G12D"), row(1, None, amp, gene="NRAS", result="Low"),
        row(2, "G12D"), row(2, None, amp, gene="nras"),
        row(3, "G12V"), row(3, None, amp, result="Negative"),
        row(4, "G12V"), row(4, None, amp, result="Negative"), row(4, None, amp, result="Intermediate"),
        row(5, "G12V"), row(5, None, "Copy Number Polymorphism", result="Negative"), row(5, None, amp, gene="HRAS"),
        row(6, "G12V", cls="uncertain"), row(6, None, amp),
    )
    assert rows_of(ras.kras_coamplified_by_variant(df), "variant", "n") == {("p.G12D", 1), ("p.G12V", 2)}
    assert ras.kras_coamplified_percent(df).first().percent_coamplified == 60.0
    assert rows_of(ras.kras_wt_amp_by_variant(df), "variant", "n") == {("p.G12V", 2)}
    assert ras.kras_wt_amp_percent(df).first().percent_wild_type == 40.0
