"""Periodic runs against a plain search over all periods, and the registered query against its contract."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from oncolens.llm import periodic_runs, queries
from tests.llm.conftest import ODD


def plain(words, exponent=4, shortest=6):
    """Every run by trying every period from the smallest."""
    seen = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(shortest, exponent * q):
                seen.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in seen.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return [w for k, w in enumerate(words) if k not in gone]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def spans(found):
    return [(r["start"], r["length"], r["period"]) for r in found]


@pytest.mark.parametrize("exponent, shortest", [(4, 6), (2, 2), (3, 9), (2, 6)])
def test_random_texts(exponent, shortest):
    pick = random.Random(exponent * 100 + shortest)
    for _ in range(400):
        docs = []
        for _ in range(pick.randrange(1, 5)):
            words = [f"w{pick.randrange(pick.choice([1, 2, 3, 5]))}" for _ in range(pick.randrange(60))]
            if words and pick.random() < 0.5:
                a, p = pick.randrange(len(words)), pick.randrange(1, 9)
                words = [words[i if i < a else min(len(words) - 1, a + (i - a) % p)] for i in range(len(words))]
            docs.append(words)
        for words, (n, runs, text) in zip(docs, periodic_runs.judged([" ".join(d) for d in docs], exponent, shortest), strict=True):
            assert n == len(words)
            assert spans(runs) == plain(words, exponent, shortest)
            assert text.split() == collapsed(words, spans(runs))


def test_neighbouring_documents_do_not_join():
    found = periodic_runs.judged(["a a a", "a a a", "", None, "a a a a a a"], 4, 6)
    assert [spans(f[1]) for f in found] == [[], [], [], [], [(0, 6, 1)]]


def test_very_long_and_nested_repetitions():
    inner = ["a"] * 7 + ["b"]
    words = inner * 300
    found = spans(periodic_runs.judged([" ".join(words)], 4, 6)[0][1])
    assert found == plain(words)
    long = " ".join(["x y z"] * 60_000) + " end"
    assert spans(periodic_runs.judged([long], 4, 6)[0][1]) == [(0, 180_000, 3)]


def test_ordered_places_over_many_blocks():
    order = np.random.default_rng(3).permutation(10_000).tolist()
    places = periodic_runs.Places(order[0])
    seen = [order[0]]
    for k, place in enumerate(order[1:], 1):
        before, after = places.add(place)
        if k % 500 == 0:
            assert before == max((s for s in seen if s < place), default=None)
            assert after == min((s for s in seen if s > place), default=None)
        seen.append(place)
    assert list(places) == list(range(10_000)) and len(places.blocks) > 4


def test_odd_rows(texts):
    docs = texts(*ODD, "t t t t t t", "t t t t t t", ids=[*range(len(ODD)), 3, None])
    rows = periodic_runs.periodic_runs(docs).collect()
    assert len(rows) == len(ODD) + 2
    assert sorted(r.n_words for r in rows) == sorted([*(len(words_of(t)) for t in ODD), 6, 6])
    assert [(r.doc_id, r.collapsed) for r in rows if r.runs] == [(3, "t"), (None, "t")]
    assert periodic_runs.periodic_runs(texts(*ODD).limit(0)).collect() == []


def contract(doc_id, text):
    words, h = words_of(text), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(collapsed(words, runs))),
    )


def test_registered_query(spark, tmp_path):
    pick = random.Random(11)
    rows = [(k, " ".join(f"w{pick.randrange(40)}" for _ in range(pick.randrange(150)))) for k in range(400)]
    rows += [(1000 + k, t) for k, t in enumerate(ODD[:6])]
    rows += [(2000 + k, " \n".join(["a b c"] * 9 + ["d"] * 8)) for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(tuple(r[c] for c in columns) for r in found) == sorted(contract(*r) for r in rows)
    assert sum(r.n_runs > 0 for r in found if r.doc_id < 400) > 10
