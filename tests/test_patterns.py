"""SIMILAR TO against a table of cases, and against the plain regular expression for random patterns."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from oncolens.functions.patterns import similar_regex, similar_to

TEXTS = [
    "immunohisto", "an immunoassay", "fish", "in situ", "copy number loss", "gene amplified", "ERBB2 gene", "HER2", "IHC",
    "ICC", "abc", "a.c", "a%c", "a_c", "", "aXXc", "abab", "ab", "a\nc", "x]y", "x-y", "x^y", "a|b", "a(b", "a\\b", "aaa", "é",
]
CASES = {
    "%immun%": ["immunohisto", "an immunoassay"],
    "%ish%|%in situ%": ["fish", "in situ"],
    "(%immun%|%ish%|%in situ%)": ["immunohisto", "an immunoassay", "fish", "in situ"],
    "(immunohisto%|%ish%|%in situ%)": ["immunohisto", "fish", "in situ"],
    "(copy number%|%amplifi%)": ["copy number loss", "gene amplified"],
    "%(ihc|in situ|ish)%": ["fish", "in situ"],
    "%(ERBB2|HER2)%": ["ERBB2 gene", "HER2"],
    "(IHC|ICC)": ["IHC", "ICC"],
    "I(H|C)C": ["IHC", "ICC"],
    "a_c": ["abc", "a.c", "a%c", "a_c", "a\nc"],
    "a.c": ["a.c"],
    "a\\%c": ["a%c"],
    "a\\_c": ["a_c"],
    "a%c": ["abc", "a.c", "a%c", "a_c", "aXXc", "a\nc"],
    "(ab)+": ["abab", "ab"],
    "(ab){2}": ["abab"],
    "a{2,}": ["aaa"],
    "aX*c": ["aXXc"],
    "a[bB.]?c": ["abc", "a.c"],
    "a[^b]c": ["a.c", "a%c", "a_c", "a\nc"],
    "x[]^-]y": ["x]y", "x-y", "x^y"],
    "a\\|b": ["a|b"],
    "a\\(b": ["a(b"],
    "a\\\\b": ["a\\b"],
    "": [""],
    "(|ab)": ["", "ab"],
    "_": ["é"],
}


@pytest.mark.parametrize("pattern", CASES)
def test_cases(spark, pattern):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "text string")
    found = df.select("text", similar_to(F.col("text"), pattern).alias("hit")).collect()
    assert [r.text for r in found if r.hit] == CASES[pattern]
    assert [r.hit for r in found if r.text is None] == [None]
    assert [r[0] for r in df.where(F.col("text").rlike(similar_regex(pattern))).collect()] == CASES[pattern]


def test_plain_patterns_are_no_regular_expressions(spark):
    df = spark.createDataFrame([("x",)], "text string")
    for pattern in ("%(ERBB2|HER2)%", "(copy number%|%amplifi%)", "a(b|c)(d|e)_"):
        plan = df.where(similar_to(F.col("text"), pattern))._jdf.queryExecution().optimizedPlan().toString()
        assert "RLIKE" not in plan
    assert "RLIKE" in df.where(similar_to(F.col("text"), "a+"))._jdf.queryExecution().optimizedPlan().toString()


def test_random_patterns(spark):
    """Both ways to run a pattern agree with Python's reading of the same expression."""
    rng = random.Random(1)

    def make(depth):
        parts = []
        for _ in range(rng.randint(1, 4)):
            part = rng.choice(["a", "b", "%", "_", ".", "\\%", "[ab]"])
            if depth and rng.random() < 0.4:
                part = "(" + "|".join(make(depth - 1) for _ in range(rng.randint(1, 3))) + ")"
            parts.append(part + rng.choice(["", "", "", "", "*", "?", "{1,2}"]))
        return "".join(parts)

    texts = ["".join(rng.choices("ab.%", k=rng.randint(0, 5))) for _ in range(120)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    patterns = [make(2) for _ in range(60)]
    row = df.select("text", *[similar_to(F.col("text"), p).alias(f"p{k}") for k, p in enumerate(patterns)]).collect()
    for k, pattern in enumerate(patterns):
        want = re.compile(similar_regex(pattern).removeprefix("(?s)").replace("\\z", "\\Z"), re.DOTALL)
        assert [r[f"p{k}"] for r in row] == [bool(want.search(t)) for t in texts], pattern


@pytest.mark.parametrize("pattern", ["(a", "a)", "*a", "a|+", "[a", "a\\", "[]", "{2}", "a**"])
def test_broken_patterns(pattern):
    with pytest.raises(ValueError, match="SIMILAR TO"):
        similar_regex(pattern)
