"""Quality scores from a sparse ensemble of rules over text statistics.

Boosted shallow trees propose conjunctions of thresholds, an L1-penalised logistic
regression weighs them, and the few rules left become one Spark column expression.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oncolens.llm.common import held_out, pick

UPPER = bytes(range(65, 91))
DIGIT = bytes(range(48, 58))
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
SENTENCE_ENDS = b".!?"

STATISTICS = (
    "n_chars", "n_words", "mean_word", "distinct_words", "top_word", "repeated_pairs", "upper", "digits", "punctuation",
    "odd_marks", "bang", "bars", "non_ascii", "lines", "distinct_lines", "words_per_line", "sentence_ends",
    "long_words", "short_words", "compression",
)


def statistics(text: str | None) -> list[float]:
    """The numbers a rule may test, in the order of STATISTICS; a null text counts as empty."""
    text = text or ""
    raw = text.encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, w, k = max(1, len(raw)), max(1, len(words)), max(1, len(lines))

    def share(marks: bytes) -> float:
        return (len(raw) - len(raw.translate(None, marks))) / n

    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    ends = n * share(SENTENCE_ENDS)
    return [
        float(len(text)),
        float(len(words)),
        float(lengths.mean()) if words else 0.0,
        len(counts) / w,
        max(counts.values(), default=0) / w,
        1 - pairs / max(1, len(words) - 1),
        share(UPPER),
        share(DIGIT),
        share(PUNCTUATION),
        share(PUNCTUATION) - share(b".,"),
        share(b"!"),
        share(b"|"),
        (len(raw) - len(text)) / n,
        float(len(lines)),
        len(set(lines)) / k,
        w / k,
        ends / w,
        float((lengths > 20).mean()) if words else 0.0,
        float((lengths < 3).mean()) if words else 0.0,
        len(zlib.compress(raw, 1)) / n if raw else 0.0,
    ]


def with_statistics(docs: DataFrame, text_column: str, into: str) -> DataFrame:
    """``docs`` with one more column, a struct of STATISTICS, in batches of Arrow rows."""
    kind = T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS])
    schema = T.StructType([*docs.schema.fields, T.StructField(into, kind)])
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t.as_py()) for t in batch.column(place)], float).reshape(-1, len(STATISTICS))
            struct = pa.StructArray.from_arrays([pa.array(c) for c in rows.T], list(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], schema.names)

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """All of ``terms`` (statistic, whether above, threshold) hold."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def matches(self, x: np.ndarray) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for s, above, at in self.terms:
            hit &= (x[:, s] > at) == above
        return hit

    def column(self, stats: str) -> Column:
        hit = F.lit(True)
        for s, above, at in self.terms:
            value = F.col(f"{stats}.{STATISTICS[s]}")
            hit = hit & (value > at if above else value <= at)
        return hit


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    bias: float

    def score(self, stats: str) -> Column:
        """Probability of label 1 as a column expression over the struct ``stats``."""
        total = F.lit(self.bias)
        for rule in self.rules:
            total = total + F.when(rule.column(stats), rule.weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def grow(x: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, depth: int, bins: int, least: int) -> list[Rule]:
    """A regression tree on the boosting gradient, as rules: one for every node below the root, leaves last.

    Returned with each leaf's value as weight; inner nodes have weight 0.
    """
    rules: list[Rule] = []

    def split(rows: np.ndarray, terms: tuple, left_depth: int) -> None:
        g, h = gradient[rows], curvature[rows]
        base, best = g.sum() ** 2 / (h.sum() + 1), (1e-6, -1, 0.0)
        if left_depth:
            for s in range(x.shape[1]):
                values = x[rows, s]
                cuts = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))
                slot = np.searchsorted(cuts, values, side="left")
                gs, hs, ns = (np.bincount(slot, v, len(cuts) + 1).cumsum()[:-1] for v in (g, h, np.ones(len(rows))))
                ok = (ns >= least) & (len(rows) - ns >= least)
                gain = np.where(ok, gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - base, -1)
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), s, float(cuts[gain.argmax()]))
        leaf = best[1] < 0
        if terms:
            rules.append(Rule(terms, float(g.sum() / (h.sum() + 1)) if leaf else 0.0))
        if not leaf:
            above = x[rows, best[1]] > best[2]
            for side in (False, True):
                split(rows[above == side], (*terms, (best[1], side, best[2])), left_depth - 1)

    split(np.arange(len(x)), (), depth)
    return rules


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and bias of an L1-penalised logistic regression, by accelerated proximal steps."""
    n, k = z.shape
    step = 4 / (np.linalg.norm(z, 2) ** 2 / n + 1)
    w = v = np.zeros(k + 1)
    ones = np.concatenate([z, np.ones((n, 1))], axis=1)
    for t in range(rounds):
        slope = ones.T @ (1 / (1 + np.exp(-(ones @ v))) - y) / n
        moved = v - step * slope
        moved[:-1] = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - step * penalty, 0)
        v, w = moved + t / (t + 3) * (moved - w), moved
    return w[:-1], float(w[-1])


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, bins: int = 24, penalty: float = 0.001, rounds: int = 400
) -> Ensemble:
    """Rules from boosted trees, then lasso weights. Where no rule can be learnt the score is the labels' smoothed mean.

    That is so without both labels, and where no threshold leaves five rows on either side.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return Ensemble((), math.log(share / (1 - share)))
    margin = np.full(len(y), math.log(share / (1 - share)))
    found: dict[tuple, Rule] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rules = grow(x, y - p, p * (1 - p), depth, bins, max(5, len(y) // 500))
        for rule in rules:
            margin += 0.3 * rule.weight * rule.matches(x)
            found.setdefault(rule.terms, rule)
    terms = list(found)
    z = np.stack([found[t].matches(x) for t in terms], axis=1).astype(float) if terms else np.zeros((len(y), 0))
    if not terms:
        return Ensemble((), math.log(share / (1 - share)))
    centre, spread = z.mean(0), np.maximum(z.std(0), 1e-3)
    w, bias = lasso((z - centre) / spread, y, penalty, rounds)
    w = w / spread
    kept = [Rule(t, float(v)) for t, v in zip(terms, w, strict=True) if v]
    return Ensemble(tuple(kept), bias - float(centre @ w))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    folds: int = 5,
    fold: int = 0,
    most_rows: int = 12_000,
) -> Ensemble:
    """Fit on labelled rows outside the held-out fold, at most about ``most_rows`` of them.

    The sample is chosen by a hash of the id, before any text is read; its ids are
    broadcast (their number is bounded by ``most_rows``). Labels that are null are no
    labels; an id labelled more than once has its smallest label.
    """
    marks = pick(labels, id="doc_id", label=label_column).where("label IS NOT NULL AND id IS NOT NULL")
    marks = marks.where(~held_out(F.col("id"), folds, fold)).groupBy("id").agg(F.min("label").alias("label"))
    share = min(1.0, most_rows / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = pick(docs, id=id_column, text=text_column).join(F.broadcast(marks), "id")
    rows = with_statistics(rows.select("id", "label", "text"), "text", "stats").select("id", "label", "stats.*")
    found = rows.orderBy("id", *STATISTICS).toPandas()
    return fit(found[list(STATISTICS)].to_numpy(float), (found["label"].to_numpy() >= 1).astype(float))


def scored(docs: DataFrame, model: Ensemble, text_column: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text; null and empty texts are scored by the same rules.

    A column named like ``into`` is replaced; others may have any name, also one that
    differs from the text's only in case.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    found = with_statistics(plain, f"c{names.index(text_column)}", "stats")
    kept = [i for i, c in enumerate(names) if c.lower() != into.lower()]
    scores = found.select(*[f"c{i}" for i in kept], model.score("stats").alias("score_of_rules"))
    return scores.toDF(*[names[i] for i in kept], into)
