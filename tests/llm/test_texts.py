"""Block anchors, packing, mixing, shards, URL rules: brute force, round trips, laws."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oncolens.llm import best_fit, block_anchors, common, filter_cascade, label_shards, poisson_mixing, rule_quality
from tests.llm.conftest import ODD


def plain_removal(rows, window):
    """(words, removed flags) per row of (id, text); null ids are larger than all."""
    words = [(t or "").encode().split() for _, t in rows]
    ids = [float("inf") if i is None else i for i, _ in rows]
    first = {}
    for i, w in zip(ids, words, strict=True):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in zip(ids, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((w, gone))
    return out


@pytest.mark.parametrize(("window", "chunk", "part"), [(13, 8 << 20, 20 << 20), (13, 900, 2000), (6, 3000, 700)])
def test_anchors_equal_brute_force(texts, window, chunk, part):
    rng = random.Random(window)
    words = [f"w{k}" for k in range(40)]
    passages = [rng.choices(words, k=n) for n in (12, 13, 14, 30, 80)]
    rows = []
    for _ in range(60):
        text = rng.choices(words, k=rng.randint(0, 40))
        for p in rng.sample(passages, rng.randint(0, 3)):
            at = rng.randint(0, len(text))
            text[at:at] = p
        rows.append(rng.choice([" ", "\n", " \t"]).join(text))
    rows += [*ODD[:7], rows[0], rows[1], "é " * 30, "é " * 30]
    ids = rng.sample(range(1000), len(rows))
    ids[3] = ids[7] = None
    ids[9] = ids[8]
    found = block_anchors.remove_repeats(texts(*rows, ids=ids), window=window, chunk_bytes=chunk, part_bytes=part).collect()
    want = []
    for i, (w, gone) in zip(ids, plain_removal(list(zip(ids, rows, strict=True)), window), strict=True):
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        want.append((i is None, i or 0, len(w), sum(gone), kept))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in found) == sorted(want)
    assert sum(r.n_removed for r in found) > 500
    assert all(sum(s.length for s in r.removed) == r.n_removed for r in found)


def test_anchors_long_text_and_empty_table(texts):
    rows = block_anchors.remove_repeats(texts(ODD[7], ODD[8])).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept_text == "end") for r in rows) == [(0, 0, False), (1, 30_000, True)]
    assert block_anchors.remove_repeats(texts("x").limit(0)).count() == 0


def test_anchors_tell_crafted_words_apart(texts):
    """Words that a polynomial over their letters gives one hash, among words that do repeat."""
    one, other = "a", "b"
    for _ in range(12):
        one, other = one + other, other + one
    shared = " ".join(f"w{k}" for k in range(12))
    rows = [f"{shared} {one}", f"{shared} {other}", f"{other} {shared}", f"{shared} {one} more"]
    found = {r.doc_id: r.n_removed for r in block_anchors.remove_repeats(texts(*rows)).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 13}


def test_windows_equal_in_half_their_bits_are_told_apart(monkeypatch):
    """All windows with one 64-bit hash: the other 32 bits decide, in the parts and in the chunks."""
    monkeypatch.setattr(block_anchors, "rolling", lambda words, n, base: np.full(max(0, len(words) - n + 1), 7, np.uint64))
    ids = pa.chunked_array([pa.array([1, 2, 3])])
    chunk = block_anchors.Chunk(ids, pa.chunked_array([pa.array(["a b c d", "x a b c", "y z x y"])]))
    (row,) = block_anchors.window_rows(chunk, 0, np.array([0], np.uint64), 2, 3, 1)
    told = block_anchors.answer_windows(pa.Table.from_pylist([row]))
    assert told.num_rows == 1
    keys, sides = (block_anchors.unpack(told.column(c)[0].as_py(), w) for c, w in (("keys", 8), ("sides", 4)))
    says = np.frombuffer(told.column("says")[0].as_py(), np.uint8)
    gone = block_anchors.covered_words(chunk, keys, sides, says, 3)
    assert gone.tolist() == [False] * 4 + [False, True, True, True] + [False] * 4


def test_rows_by_part_cover_the_hash_space():
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 1 << 64, 5000, np.uint64))
    rows = block_anchors.rows_by_part(1_000_000_000, 3, keys, lambda s: {"keys": block_anchors.pack(keys[s], 8)})
    assert len(rows) <= len(keys) and [r["part"] for r in rows] == sorted({r["part"] for r in rows})
    assert np.concatenate([block_anchors.unpack(r["keys"], 8) for r in rows]).tolist() == keys.tolist()
    assert all(0 <= r["part"] < 1_000_000_000 for r in rows)


def test_rows_without_an_id_are_spread(spark):
    """A third of all rows equal and without an id: no chunk has them all, and all keep what only they share."""
    text = " ".join(f"n{k}" for k in range(40))
    rows = [(None, text)] * 300 + [(k, f"own {k} " + text) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = block_anchors.remove_repeats(docs, chunk_bytes=3000).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in found) == [(False, 0), (False, 40), (False, 40)] + [(True, 40)] * 300


def best_fit_by_item(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([7, 32, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))] + [capacity // 3] * rng.randint(0, 50)
        lengths = [n for n in lengths if n]
        table = np.array(sorted(best_fit.plan(Counter(lengths), capacity)), np.int64).reshape(-1, 5)
        used = defaultdict(list)
        for n, count in Counter(lengths).items():
            bins, offsets = best_fit.place(table, np.full(count, n), np.arange(count))
            for b, o in zip(bins.tolist(), offsets.tolist(), strict=True):
                used[b].append((o, n))
        for parts in used.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sorted(capacity - sum(n for _, n in p) for p in used.values()) == best_fit_by_item(lengths, capacity)


def test_encoder_gives_the_tokenizers_ids():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rng = random.Random(6)
    letters = "ab 's\t\n\x0b\x0c\r\x1c\x1f\x85\xa0'½²³¹_-.,éǅɏ1٣日\u0301"
    rows = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(3000)]
    rows += ["<|endoftext|> x", "a  b\n\n c'll 'stop", *[t for t in ODD if t]]
    encoder = best_fit.Encoder.of(path)
    for text, want in zip(rows, plain.encode_batch(rows, add_special_tokens=False), strict=True):
        assert encoder.encode(text) == np.array(want.ids, "<u4").tobytes()


@pytest.mark.parametrize("capacity", [8, 1024])
def test_packing_round_trip(texts, capacity):
    rows = [*ODD, *["same text here"] * 30]
    packed = best_fit.pack(texts(*rows), capacity=capacity, with_ids=True)
    found = packed.collect()
    encoder = best_fit.Encoder.of(public_tokenizers.path("byte_bpe_50k.json"))
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for k, text in enumerate(rows):
        parts = sorted(by[k], key=lambda r: r.piece)
        assert b"".join(p.ids for p in parts) == encoder.encode(text or "") + b"\2\0\0\0"
        assert [p.start for p in parts] == [sum(q.length for q in parts[:j]) for j in range(len(parts))]
        assert all(p.length == capacity for p in parts[1:])
    whole = {r.sequence_id: r.ids for r in best_fit.sequences(packed).collect()}
    for r in found:
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids
    assert sum(map(len, whole.values())) == sum(len(r.ids) for r in found)
    rooms = best_fit_by_item([r.length for r in found], capacity)
    assert sorted(capacity - len(v) // 4 for v in whole.values()) == rooms
    fine = best_fit.pack(texts(*rows), capacity=capacity, cells=1, cell_rows=3).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in fine) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in found)
    used = defaultdict(list)
    for r in fine:
        used[r.sequence_id].append((r.offset, r.length))
    assert all(o == sum(n for p, n in parts if p < o) for parts in used.values() for o, _ in parts)
    assert sorted(capacity - sum(n for _, n in parts) for parts in used.values()) == rooms
    assert best_fit.pack(texts("x").limit(0)).count() == 0


def mixed(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copy string")


def test_mixing_reaches_targets(spark):
    rows = [(k, "x" * 9, "big" if k % 10 else "small", "c") for k in range(4000)]
    found = poisson_mixing.replicate(mixed(spark, rows), weights={"big": 1, "small": 3}).collect()
    counts = Counter(r.source for r in found)
    assert abs(counts["small"] / 3000 - 1) < 0.1 and abs(counts["big"] / 1000 - 1) < 0.1
    copies = defaultdict(list)
    for r in found:
        copies[r.doc_id].append(r)
    assert all(sorted(r.copy for r in c) == list(range(c[0].copies)) for c in copies.values())
    again = poisson_mixing.replicate(mixed(spark, rows).repartition(7), weights={"big": 1, "small": 3})
    assert Counter(again.collect()) == Counter(found)


def test_mixing_inverts_the_distribution():
    for rate in (0.0, 0.3, 5.0, 900.0, 1e6):
        first, cdf = poisson_mixing.cumulative(rate)
        assert abs(cdf[-1] - 1) < 1e-9
        median = first + sum(c <= 0.5 for c in cdf)
        assert abs(median - rate) <= 1


def test_mixing_odd_tables(spark):
    rows = [(None, None, None, "c"), (1, "", "a", "c"), (1, "", "a", "c"), (2, "x" * 5000, "b", "c")]
    found = poisson_mixing.replicate(mixed(spark, rows), weights={"a": 1}).collect()
    assert {r.source for r in found} == {"a"} and {r.doc_id for r in found} == {1}
    assert len(found) > 4000 and len(found) == 2 * found[0].copies  # rows that repeat an id have the same count
    assert poisson_mixing.replicate(mixed(spark, rows).limit(0)).count() == 0
    assert poisson_mixing.replicate(mixed(spark, rows), weights={}).count() == 0


@pytest.mark.parametrize("alone", [500, 0])
def test_shards_keep_the_law_and_the_groups(texts, alone):
    rows = [*ODD, *[f"text {k % 90}" for k in range(300)], *["hot"] * 400, *[f"alone {k}" for k in range(alone)]]
    found = label_shards.shards(texts(*rows), n_shards=7).collect()
    assert sorted(r.doc_id for r in found) == list(range(len(rows)))
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        raw = (rows[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    assert set(slots) == set(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    where = defaultdict(set)
    for r in found:
        where[rows[r.doc_id] or ""].add(r.shard)
    if alone:  # where everything is linked and no shard has room, only the law holds
        assert len(where["hot"]) <= 4  # a third of all rows needs three shards
        assert sum(len(s) == 1 for s in where.values()) >= 0.9 * len(where)


def test_shards_odd_tables(texts):
    assert label_shards.shards(texts("x").limit(0)).count() == 0
    few = label_shards.shards(texts("a", "a", None, ids=[1, 1, None]), n_shards=5).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0] and len({r.shard for r in few}) == 3


ALLOW, BLOCK = ["com/", "www.example.com/en/"], ["example.com/en/", "net/es/", "net/fr/"]


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:cut].translate({c: c + 32 for c in range(65, 91)})
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = []
    for rule in ALLOW + BLOCK:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append(rule)
    best = max(fits, key=len, default=None)
    return host, path, best, "block" if best in BLOCK else "allow"


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(8)
    hosts = ["example.com", "WWW.Example.com", "m.example.com", "com", "net", "a.b.net", "xcom", "x.org", "", "com:80", "İ.com"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/es/1", "/fr/", "/english", "?q=/en/", "#a", "/en/?x#y", "/a://b/en/"]
    urls = [f"http{rng.choice(['', 's'])}://{h}{p}" for h in hosts for p in paths] + [None, "", "com/en/", "://net/es/", "x://a?://net/es/"]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    found = {r.page_id: r for r in filter_cascade.judge(df, ALLOW, BLOCK).collect()}
    for k, u in enumerate(urls):
        assert tuple(found[k])[1:] == plain_verdict(u), u
    odd = ["http://" + "a." * 200_000 + "Example.com/en/x", "http://" + "." * 50_000 + "/en/", "http://net" + "/es/" * 90_000]
    for r in filter_cascade.judge(spark.createDataFrame(list(enumerate(odd)), "page_id long, url string"), ALLOW, BLOCK).collect():
        assert tuple(r)[1:] == plain_verdict(odd[r.page_id])
    assert filter_cascade.judge(df.limit(0), ALLOW, BLOCK).count() == 0
    assert {r.verdict for r in filter_cascade.judge(df, [], []).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"k{n}" for n in range(3000)]
    listed = set(random.Random(9).sample(keys, 400))
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    made = filter_cascade.cascade(universe, spark.createDataFrame([(k,) for k in [*listed, "absent"]], "key string"), "c")
    assert len(made.levels) > 2 and [k for k in keys if k in made] == [k for k in keys if k in listed]


@pytest.mark.parametrize("text", ["one text", None])
def test_rows_without_an_id_are_drawn_one_by_one(spark, text):
    """A thousand equal rows without an id at rate 1 give about a thousand, spread over tasks."""
    rows = [(None, text or f"text {k}", "s") for k in range(1000)] + [(k, f"text {k}", "s") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = poisson_mixing.replicate(docs, weights={"s": 1})
    counts = dict(found.groupBy(F.col("doc_id").isNull()).count().collect())
    assert all(850 < n < 1150 for n in counts.values()) and len(counts) == 2
    spread = found.where("doc_id IS NULL").select("shuffle_key").distinct().count()
    assert spread == counts[True]


def test_names_of_other_columns_do_not_matter(spark):
    names = ["doc_id", "text", "source", "TEXT", "Source", "mix_u", "u", "cdf", "rated_source", "draw_id", "block", "copy"]
    docs = spark.createDataFrame([(k, f"text {k}", "s", *[k] * 9) for k in range(50)], [f"x{k}" for k in range(12)]).toDF(*names)
    found = poisson_mixing.replicate(docs, weights={"s": 1})
    assert found.columns == [*names[:-1], "rate", "copies", "copy", "shuffle_key"]
    rows = found.collect()
    assert len(rows) > 20 and all(list(r[3:11]) == [r[0]] * 8 and r[1] == f"text {r[0]}" for r in rows)
    model = rule_quality.Ensemble((), 0.0)
    scored = rule_quality.scored(docs, model, into="SCORE")
    assert scored.columns == [*names, "SCORE"] and {r[-1] for r in scored.collect()} == {0.5}


def test_shards_use_more_cells_for_more_rows(spark, monkeypatch):
    """With few rows to a cell the result keeps its laws, and more counts are taken."""
    monkeypatch.setattr(label_shards, "REST_CELLS", 16)
    monkeypatch.setattr(label_shards, "CELL_ROWS", 4)
    docs = spark.createDataFrame([(k, f"t{k if k % 5 else 0}") for k in range(3000)], "doc_id long, text string")
    found = label_shards.shards(docs, n_shards=7).collect()
    sizes = Counter(r.shard for r in found)
    assert len(found) == 3000 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(n)) for s, n in sizes.items())


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)
    Context.master = "local-cluster[3,2,1024]"
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)
