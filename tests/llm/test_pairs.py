"""SimHash groups, embedding links, phrase fingerprints: against every pair or a plain parse."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from oncolens.llm import common, lz_fingerprint, pca_tiles, simhash
from tests.llm.conftest import ODD


def smallest_reachable(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a in range(n):
            for b in range(n):
                if linked(a, b) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def plain_simhash(text, shingle):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + shingle]), 42) for k in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def some_texts():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(15)]
    near = [t.replace(" w7 ", " W8 ", 1) for t in base for _ in range(2)]
    return [*ODD, *base, *near, *base[:4]]


@pytest.mark.parametrize("tile_size", [7, 16384])
def test_simhash_equals_all_pairs(texts, tile_size):
    rows = some_texts()
    codes = [plain_simhash(t, 4) for t in rows]
    label = smallest_reachable(len(rows), lambda a, b: (codes[a] ^ codes[b]).bit_count() <= 4)
    found = {r.id: r for r in simhash.near_duplicates(texts(*rows), tile_size=tile_size).collect()}
    assert [found[k].fp % 2**64 for k in range(len(rows))] == codes
    assert [found[k].component for k in range(len(rows))] == label
    assert len(set(label)) < len(rows) - 10


def test_simhash_keeps_one_of_each(texts, spark):
    df = texts("a b c d e", "a b c d e", "other words entirely here", None, "", ids=[4, 2, None, None, 9])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in kept.collect()) == [
        (False, 2, "a b c d e"), (False, 9, ""), (True, 0, "other words entirely here"),
    ]
    repeated = texts("a b c d e", "a b c d e", ids=[1, 1])
    assert simhash.keep_one(repeated).count() == 1
    assert simhash.near_duplicates(texts("x").limit(0)).count() == 0
    assert simhash.keep_one(texts("x").limit(0)).count() == 0


def test_simhash_keeps_every_unique_text_of_a_repeated_id(texts):
    one, two, three, four = (" ".join(f"{w}{k}" for k in range(40)) for w in "abcd")
    rows = [(1, one), (2, one), (2, two), (3, three), (3, four), (3, four), (None, two), (4, two)]
    for order in (1, -1):
        df = texts(*[t for _, t in rows[::order]], ids=[k for k, _ in rows[::order]]).repartition(8)
        found = simhash.keep_one(df)
        assert found.columns == df.columns
        assert sorted((r[0], r[1]) for r in found.collect()) == [(1, one), (2, two), (3, three), (3, four)]
    same = texts("A B C D E", "a b c d e", "A b c d E", ids=[7, 7, 7])  # one fingerprint, three texts
    assert [r[1] for r in simhash.keep_one(same).collect()] == ["A B C D E"]


def test_tiles_cover_every_pair_in_reach():
    rng = random.Random(1)
    counts = {p: rng.choice([0, 3, 50, 400]) for p in range(65)}
    spans = simhash.plan_tiles(counts, 4, 60)
    for p in range(65):
        for q in range(65):
            if abs(p - q) <= 4:
                first, parts, _, _ = spans[q]
                assert spans[p][2] <= first and first + parts - 1 <= spans[p][3]


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(159, 7)]
    found = dict(common.components(spark.createDataFrame(links, "a long, b long"), "chain").collect())
    assert found == {k: 0 for k in [*range(41), *range(100, 160)]}


def vectors_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")


@pytest.mark.parametrize(("tile_size", "block"), [(8192, 1024), (13, 5)])
def test_embeddings_equal_all_pairs(spark, tile_size, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 90)] + rng.normal(scale=0.28, size=(90, 16)), rng.normal(size=(20, 16))])
    x = np.concatenate([x, x[:6], 3 * x[:3]]).astype(np.float32)
    rows = [(k, v.tolist(), 0, "a") for k, v in enumerate(x)]
    n = len(rows)
    bad = [None, [], [0.0] * 16, [None, *[1.0] * 15], [float("nan"), *[1.0] * 15], [float("inf"), *[1.0] * 15]]
    rows += [(n + k, v, 0, "a") for k, v in enumerate(bad)] + [(n + 6, [1.0, 2.0], 0, "a"), (n + 7, [2.0, 4.0], 0, "a")]
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cosine = u @ u.T >= 0.9
    np.fill_diagonal(cosine, False)
    label = smallest_reachable(n, lambda a, b: cosine[a, b])
    found = {r.vec_id: r for r in pca_tiles.near_duplicates(vectors_frame(spark, rows), tile_size=tile_size, block=block).collect()}
    assert [found[k].n_links for k in range(n)] == cosine.sum(1).tolist()
    assert [found[k].component_id for k in range(n)] == label
    assert 12 < len(set(label)) < n - 30
    assert all((found[n + k].n_links, found[n + k].component_id, found[n + k].kept) == (0, n + k, True) for k in range(6))
    assert (found[n + 7].n_links, found[n + 7].component_id, found[n + 7].kept) == (1, n + 6, False)


def test_embeddings_empty_and_all_bad(spark):
    assert pca_tiles.near_duplicates(vectors_frame(spark, [(1, [1.0], 0, "a")]).limit(0)).count() == 0
    assert pca_tiles.near_duplicates(vectors_frame(spark, [(1, None, 0, "a"), (None, [0.0], 0, "a")])).count() == 2


def plain_phrases(text):
    seen, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in seen:
            seen.add(phrase)
            phrase = ""
    return seen


def test_parse_is_plain_lz78():
    rng = random.Random(2)
    for n in [0, 1, 2, 3, 4, 5, 40, 400]:
        text = "".join(rng.choices("abé日", k=n))
        seen, ends = set(), []
        lz_fingerprint.parse(text, 0, seen, ends)
        assert seen == plain_phrases(text) and (ends[-1] if n else 0) == n


def test_edit_likeness_equals_plain(texts):
    rows = some_texts()
    ids = [3 * k for k in range(len(rows))]
    found = lz_fingerprint.edit_likeness(texts(*rows, ids=ids), run_bytes=50_000).collect()
    found = sorted(found, key=lambda r: r.doc_id)
    assert [r.doc_id for r in found] == ids

    def plain(text):
        hashes = [lz_fingerprint.phrase_hashes(p, 0, [len(p)]) for p in plain_phrases(text)]
        return lz_fingerprint.signature(lz_fingerprint.least(np.concatenate([np.zeros(0, np.uint64), *hashes])))

    for k, r in enumerate(found):
        text, after = rows[k] or "", rows[(k + 1) % len(rows)] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        own, edit, other = plain(text), plain(changed), plain(after)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (lz_fingerprint.code(own), lz_fingerprint.code(edit))
        assert (r.near_edited, r.near_next) == (lz_fingerprint.likeness(own, edit), lz_fingerprint.likeness(own, other))


def test_edit_likeness_of_hot_ids(spark):
    """Rows without an id, and copies of a row, lie in several runs and follow each other all the same."""
    rng = random.Random(4)
    rows = [(None, " ".join(rng.choices(["ab", "cd", "ef"], k=rng.randint(0, 30)))) for _ in range(300)]
    rows += [(7, f"text {k} of one id") for k in range(200)] + [(9, "the same row")] * 150 + [(-1, "first"), (10, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    runs = lz_fingerprint.with_next(docs, 500, 1000)
    sizes = [r["count"] for r in runs.where("NOT guest").groupBy("run").count().collect()]
    assert len(sizes) > 10 and runs.where("guest").count() == len(sizes)
    null_runs = runs.where("NOT known").select("run").distinct().count()
    assert null_runs > 3 and max(sizes) <= 200
    found = lz_fingerprint.edit_likeness(docs, run_bytes=500).collect()
    assert sorted(map(repr, (r.doc_id for r in found))) == sorted(repr(i) for i, _ in rows)
    keys = docs.select("doc_id", "text", F.xxhash64("text").alias("print")).collect()
    ordered = sorted(keys, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.print))
    want = []
    for k, r in enumerate(ordered):
        after, half = ordered[(k + 1) % len(ordered)].text, len(r.text) // 2
        changed = r.text[: len(r.text) - half] + after[:half]
        near = lz_fingerprint.likeness(lz_fingerprint.fingerprint(r.text), lz_fingerprint.fingerprint(after))
        want.append((repr(r.doc_id), hashlib.sha256(changed.encode()).hexdigest(), near))
    assert sorted((repr(r.doc_id), r.edited_sha256, r.near_next) for r in found) == sorted(want)
    few = lz_fingerprint.edit_likeness(docs, run_bytes=500, most_runs=3).collect()
    assert sorted(map(repr, few)) == sorted(map(repr, found))


def test_copies_in_a_row_are_parsed_once(monkeypatch):
    calls, real = [], lz_fingerprint.edited
    monkeypatch.setattr(lz_fingerprint, "edited", lambda a, b: calls.append(a) or real(a, b))
    rows = [(True, 1, "copy", False)] * 500 + [(True, 2, "other", False), (None, None, "copy", True)]
    assert len(list(lz_fingerprint.in_order(iter(rows)))) == 501 and len(calls) == 3


def test_edit_likeness_odd_tables(texts):
    assert lz_fingerprint.edit_likeness(texts("x").limit(0)).count() == 0
    alone = lz_fingerprint.edit_likeness(texts("abcd")).first()
    assert (alone.near_next, alone.n_chars) == (1.0, 4)
    rows = lz_fingerprint.edit_likeness(texts("abcd", "wxyz", None, "wxyz", ids=[1, None, None, 1])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in rows) == [(False, 1, 4), (False, 1, 4), (True, 0, 0), (True, 0, 4)]
    prints = {r.doc_id: r.fingerprint for r in lz_fingerprint.fingerprints(texts(None, "", "ab", "ab")).collect()}
    assert prints[0] == prints[1] == "ffff" * 128 and prints[2] == prints[3] != prints[0]
