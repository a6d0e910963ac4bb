"""Codes, names, patterns and ordered rules as data.

All literals in this file are fixed values: they must equal the source
vocabularies for results to be right.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- HER2 tests -----------------------------------------------------------
HER2_CODES = ("18474-7", "72383-3", "31150-6", "49683-6", "74860-8")
HER2_GENE_CODE = "3430"
HER2_AMPLIFICATION_CODE = "C16152"
HER2_STATUS_CODE = "48676-1"
HER2_STATUS_SCORES = ("0", "0+", "1", "1+", "2", "2+", "3", "3+")
AMPLIFICATION_TEST_TYPES = "(copy number%|%amplifi%)"

# Patterns of METHODS, TEST_TYPES, PATTERN and NAMES are SIMILAR TO patterns.
# Test methods that count for the coded HER2 tests. The two cohort families
# differ: one wants the word to start with immunohisto, one takes it anywhere.
METHODS_PREFIX = "(immunohisto%|%ish%|%in situ%)"
METHODS_CONTAINS = "(%immun%|%ish%|%in situ%)"

# --- ER / PR tests --------------------------------------------------------
ER_CODES = ("14228-1", "40556-3", "16112-5")
ER_GENE_CODE = "3467"
PR_CODES = ("16113-3", "14230-7", "40557-1")
PR_GENE_CODE = "8910"
HORMONE_PANEL = "%hormone recept%"
RECEPTOR_DIAGNOSIS = "%z17.%"
GENE_TO_RECEPTOR = {"ESR1": "ER", "PGR": "PR"}
RECEPTOR_GENE_TEST_TYPES = ("IHC", "ICC")

# --- methods --------------------------------------------------------------
IHC_PATTERN = "%immun%"
IHC_PATTERN_GENETIC = "%(immun|ihc)%"
FISH_PATTERN = "%ish%|%in situ%"
GENETIC_HER2_METHODS = "%(ihc|in situ|ish)%"
HER2_NAMES = "%(ERBB2|HER2)%"
GENETIC_HER2_UNITS = ("Staining Intensity (+)", "ERBB2:CEP17", "HER2/CEP-17 ratio", "Her2/Neu/Chromosome 17 Ratio")
ISH_TEST_TYPES = ("Chromogenic In Situ Hybridization", "FISH")
GENETIC_SCORES = ("0", "0.0", "1", "1.0", "2", "2.0", "3", "3.0")
OTHER_METHOD = "Other/Not Specified"

# --- results --------------------------------------------------------------
NUMERIC_MISSING = "000-000-000"
IHC_SCORES = ("0", "0+", "1", "1.0", "1+", "1-2", "2", "2.0", "2+", "2-3", "3", "3.0", "3+")
FISH_SCORES = ("0", "0-1", "1", "1+", "1-2", "2", "2+", "2-3", "3", "3+")
NEGATIVE_NAMES = ("Negative", "Wild Type")
POSITIVE_NAMES = ("Positive", "High")
UNKNOWN_HER2_NAMES = ("Insufficient sample", "Not Recorded", "Suppressed", "Unknown", "Not performed")
UNKNOWN_RECEPTOR_NAMES = ("Indeterminate", "Insufficient sample", "Not Recorded", "Suppressed", "Unknown")


@dataclass(frozen=True)
class ResultRule:
    """One ordered rule: every stated part must hold."""

    label: str
    names: tuple[str, ...] = ()
    numerics: tuple[str, ...] = ()
    numeric_missing: bool = False
    name_may_be_missing: bool = False
    ihc_only: bool = False


SHARED_RULES = (
    ResultRule("Positive", names=POSITIVE_NAMES),
    ResultRule("Negative", names=NEGATIVE_NAMES),
    ResultRule("Unknown", names=UNKNOWN_HER2_NAMES, name_may_be_missing=True),
)

REVISED_RULES = (
    ResultRule(
        "Low",
        names=("Borderline", "Indeterminate", "Intermediate", "Not Recorded", "Low"),
        numerics=("1.0", "1", "1+", "1-2"),
        ihc_only=True,
    ),
    ResultRule(
        "Borderline",
        names=("Borderline", "Indeterminate", "Intermediate", "Not Recorded"),
        numerics=("2.0", "2", "2+"),
        ihc_only=True,
    ),
    ResultRule("Low", names=("Negative",), numerics=("1", "1+", "1.0"), ihc_only=True),
    ResultRule(
        "Borderline",
        names=("Borderline", "Intermediate", "Indeterminate", "Equivocal"),
        numeric_missing=True,
        ihc_only=True,
    ),
    *SHARED_RULES,
)

CURRENT_RULES = (
    ResultRule("Low1+", numerics=("1.0", "1", "1+", "1-2"), ihc_only=True),
    ResultRule("Low2+", numerics=("2.0", "2", "2+", "2-3"), ihc_only=True),
    *SHARED_RULES,
)


@dataclass(frozen=True)
class Ruleset:
    rules: tuple[ResultRule, ...]
    low: str

    @property
    def settled(self) -> tuple[str, str]:
        """The results among which a day's tests may change to ``low``."""
        return (self.low, "Negative")


RULESETS = {"revised": Ruleset(REVISED_RULES, "Low"), "current": Ruleset(CURRENT_RULES, "Low1+")}

# Every number a rule or a score list names.
KNOWN_NUMERICS = tuple(
    sorted(
        {*IHC_SCORES, *FISH_SCORES, *HER2_STATUS_SCORES}
        | {number for ruleset in RULESETS.values() for rule in ruleset.rules for number in rule.numerics}
    )
)

# --- RAS ------------------------------------------------------------------
# Case-insensitive, unanchored, tried in this order; a dot is a wildcard.
VARIANT_PATTERNS = (
    ("G12D|G21D|35G>A|35>A", "p.G12D"),
    ("G12V|35G>T", "p.G12V"),
    ("G12R", "p.G12R"),
    ("c.35G>C|p.G12A", "p.G12A"),
    ("c.34G>T|p.G12C", "p.G12C"),
    ("Q61H|183a", "p.Q61H"),
    ("Q61K", "p.Q61K"),
    ("Q61R|Q16R", "p.Q61R"),
    ("Q61L", "p.Q61L"),
    ("G13D", "p.G13D"),
    ("T58I", "p.T58I"),
    ("G12L", "p.G12L"),
    ("A146T", "p.A146T"),
)
EXON_PATTERN = "exon 2|exon2"
EXON_EXCLUDES = "G393D|G12"
EXON_LABEL = "Exon 2"
MISSING_VARIANT_LABELS = {"Gene Amplification": "GeneAmp", "Gene Rearrangement Abnormality": "GeneRearrang"}

RAS_RESULTS = ("Positive", "Equivocal")
RAS_VARIANT_TYPES = (
    "Gene Mutation",
    "Gene Deletion",
    "Deletion Mutation",
    "Gene Amplification",
    "Gene Rearrangement Abnormality",
    "Exon Deletion",
    "Exon Duplication",
)
HARMLESS_CLASSES = "benign|unknown|uncertain"
AMPLIFIED_RESULTS = ("Positive", "Equivocal", "Intermediate", "Low")
COPY_NUMBER_TYPES = ("Gene Amplification", "Copy Number Polymorphism")

# --- cohort ---------------------------------------------------------------
SECOND_PRIMARY_CODE = "109359008"
