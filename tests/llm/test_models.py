"""Quality rules and language: held-out accuracy, and the learnt parts against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oncolens.llm import cross_parsing, rule_quality
from oncolens.llm.common import held_out
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = rule_quality.learn(docs, labels)
    found = rule_quality.scored(docs.select("doc_id", "text"), model).join(labels, "doc_id")
    rows = found.where(held_out(F.col("doc_id"), 5, 0)).select("quality", "score").collect()
    assert len(rows) > 50 and np.mean([(r.score >= 0.3) == r.quality for r in rows]) >= 0.95
    good = found.where("quality = 1").select(F.avg((F.col("score") >= 0.3).cast("int"))).first()[0]
    assert good >= 0.98


def test_rules_as_columns_score_like_rules_as_arrays(spark):
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(800, len(rule_quality.STATISTICS))))
    y = ((x[:, 3] > 0.5) & (x[:, 5] < 1.0)).astype(float)
    model = rule_quality.fit(x, y, trees=8)
    assert 0 < len(model.rules) < 60
    frame = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], ["id", *rule_quality.STATISTICS])
    frame = frame.select("id", F.struct(*rule_quality.STATISTICS).alias("s"))
    found = np.array([r[0] for r in frame.orderBy("id").select(model.score("s")).collect()])
    margin = model.bias + sum(r.weight * r.matches(x) for r in model.rules)
    assert np.allclose(found, 1 / (1 + np.exp(-margin)))
    assert ((found > 0.5) == y).mean() > 0.97


def test_quality_odd_tables(texts, spark):
    docs = texts(*ODD)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = rule_quality.learn(docs, none)
    plain = docs.toDF("doc_id", "text", "fp", "other")
    assert {r.score for r in rule_quality.scored(plain, model).collect()} == {0.5}
    some = spark.createDataFrame([(1, None), (2, 0), (2, 1), (3, 1), (None, 1)], "doc_id long, quality int")
    found = rule_quality.scored(plain, rule_quality.learn(docs, some)).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert rule_quality.scored(plain.limit(0), model).count() == 0


def test_quality_learns_from_few_labels():
    x = np.zeros((14, len(rule_quality.STATISTICS)))
    x[:7, 3] = 1
    model = rule_quality.fit(x, x[:, 3])
    margin = model.bias + sum(r.weight * r.matches(x) for r in model.rules)
    assert model.rules and ((margin > 0) == (x[:, 3] > 0)).all()
    assert rule_quality.fit(x[:0], x[:0, 3]) == rule_quality.Ensemble((), 0.0)
    assert not rule_quality.fit(x[5:9], x[5:9, 3]).rules  # both labels, too few rows for a rule


def test_automaton_takes_longest_matches():
    rng = random.Random(3)
    for _ in range(40):
        text = "".join(rng.choices("abc", k=rng.randint(1, 40)))
        made = cross_parsing.Parser((("l", text),))
        for _ in range(10):
            probe = "".join(rng.choices("abcd", k=rng.randint(0, 20)))
            i, want = 0, 0
            while i < len(probe):
                j = i + 1
                while j < len(probe) and probe[i : j + 1] in text:
                    j += 1
                i, want = j, want + 1
            assert made.phrases([probe.encode()]).tolist() == [[want]]


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = cross_parsing.predicted(docs, cross_parsing.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    rows = found.where(held_out(F.col("doc_id"), 3, 1)).collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97


def test_language_is_learnt_from_long_texts(spark):
    rng = random.Random(5)
    long = {"aa": ["the", "and", "this", "with"], "bb": ["der", "und", "dies", "mit"]}
    rows = [(k, " ".join(rng.choices(words, k=6000)), lang) for lang, words in long.items() for k in range(ord(lang[0]), ord(lang[0]) + 1)]
    rows.append((200, "qqq " * 5, "bb"))  # the only short text of its language is junk
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert docs.where("length(text) <= 20000").count() == 1
    references = dict(cross_parsing.learn(docs, folds=1000, fold=999))
    assert set(references) == {"aa", "bb"}
    assert set(references["aa"].split()) == set(long["aa"]) and set(references["bb"].split()) == {*long["bb"], "qqq"}
    probe = docs.select(F.col("doc_id"), F.substring("text", 1, 60).alias("text"), "lang").where("doc_id < 200")
    found = cross_parsing.predicted(probe, tuple(references.items())).collect()
    assert {r.lang_pred for r in found if r.doc_id < 98} == {"aa"}


def test_references_are_running_text(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 4))) for _ in range(300)] + ["x" * 500]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 4000))) for _ in range(20)]
    docs = spark.createDataFrame([(k, t, "l") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    for most in (1, 2, 50, 400, 9_000, 60_000, 10_000_000):
        ((lang, found),) = cross_parsing.learn(docs, folds=1000, fold=999, reference_bytes=most)
        read = len(found.encode())
        assert lang == "l" and found[0] == found[-1] == " " and read <= most + 2
        if most > 600:
            assert read > min(most - 600, sum(len(t.encode()) for t in texts))
            parts = [p for t in texts for p in (t[:1_300],) if p in found]  # every text speaks before one speaks twice
            assert len(parts) >= min(len([t for t in texts if len(t) > 1_400]), most // 2_600)
    many = docs.withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 7))
    assert [lang for lang, _ in cross_parsing.learn(many, folds=1000, fold=999, most_languages=2)] == ["l0", "l1"]


def plain_phrases(reference, text):
    """Longest matches one after the other, each looked for in the reference as a whole."""
    i = found = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in reference:
            j += 1
        i, found = max(i + 1, j - 1), found + 1
    return found


@pytest.mark.parametrize("wide", [1, 24, 10**9])
def test_bits_equal_plain_cross_parsing(monkeypatch, wide):
    """Whether texts are walked together, one by one, or both."""
    monkeypatch.setattr(cross_parsing, "WIDE", wide)
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdeé日", k=rng.randint(1, 5))) for _ in range(60)]
    references = tuple((name, " " + " ".join(rng.choices(words[a:b], k=400)) + " ") for name, a, b in (("p", 0, 40), ("q", 20, 60)))
    texts = [" ".join(rng.choices([*words, "Zz", "ÀB", "12", "x_y"], k=rng.randint(1, 120))) for _ in range(90)]
    found = cross_parsing.Parser(references).bits(texts)
    for text, bits in zip(texts, found.tolist(), strict=True):
        read = cross_parsing.as_read(cross_parsing.running(text))
        want = [plain_phrases(r.encode(), read) * math.log2(len(r.encode()) + 1) / len(read) for _, r in references]
        assert bits == pytest.approx(want, rel=1e-12)


def test_language_odd_tables(texts):
    references = (("a", " the of and this "), ("b", " der die und das "))
    found = {r.doc_id: r for r in cross_parsing.predicted(texts("the AND", "und 12", None, "", "12 !?", "日本", *ODD), references).collect()}
    assert [found[k].lang_pred for k in range(5)] == ["a", "b", "und", "und", "und"]
    assert found[5].lang_pred == "a"  # neither knows it: a tie, the first by name
    assert all(0 <= r.score <= 1 for r in found.values())
    assert {r.lang_pred for r in cross_parsing.predicted(texts("the"), ()).collect()} == {"und"}
    assert cross_parsing.learn(texts("x").withColumn("lang", F.lit(None).cast("string"))) == ()
    assert cross_parsing.predicted(texts("x").limit(0), references).count() == 0
