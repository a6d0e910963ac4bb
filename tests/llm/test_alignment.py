"""Cross-tokenizer alignment against a plain walk over byte ends."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from oncolens.llm import best_fit, queries, token_alignment
from tests.llm.conftest import ODD

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
BYTE = {letter: b for b, letter in best_fit.byte_letters().items()}


def tokens(text):
    a = A.encode(" " + text, add_special_tokens=False).ids
    bytes_a = [bytes(BYTE[c] for c in A.id_to_token(i)) for i in a]
    b = B.encode(text)
    pieces = [B.id_to_piece(i) for i in b]
    bytes_b = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
    return a, bytes_a, b, bytes_b


def plain_groups(text):
    """[(A ids, B ids), ...] of one text."""
    if not text:
        return []
    a, bytes_a, b, bytes_b = tokens(text)
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return []
    ends = []
    for parts in (bytes_a, bytes_b):
        total, own = 0, []
        for p in parts:
            total += len(p)
            own.append(total)
        ends.append(own)
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return groups


def plain(rows):
    groups = [plain_groups(t) for _, t in rows]
    linked = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(pair for c in linked for pair in c)
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    out = []
    for (i, _), g, c in zip(rows, groups, linked, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append(
            (
                i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
                sum(n for p, n in c.items() if count[p] == highest[p[0]]),
                sum(n * count[p] for p, n in c.items()), text,
            )
        )
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


SAMPLE = [
    "The quick brown fox.", "  two  spaces\n\n\nand lines\t\tend ", "naïve café 日本語 텍스트 😀😀", "▁ is a piece's space",
    "<0x41> <s> </s> <unk> <|endoftext|>", "don't we'll 12345678901234567890", "aaaaaaaaaaaaaaaaaaaaaaaa" * 9, "\r\n\x00\x07",
    " ", "\n", "é", "ﬁne", " " * 400 + "x" + "\n" * 333, "=-" * 500,
]


def test_equals_plain_walk(texts, monkeypatch):
    pick = random.Random(8)
    rows = [*SAMPLE, *ODD[:7], *SAMPLE[:3]]
    rows += ["".join(pick.choice(["the ", "and", " of", "x", "\n", "é", "日", " ", "9", "<", "un", "ing"]) for _ in range(pick.randrange(80))) for _ in range(60)]
    ids = [None if k % 17 == 3 else k // 2 for k in range(len(rows))]
    found = token_alignment.align(texts(*rows, ids=ids).repartition(4)).collect()
    assert ordered(found) == ordered(plain(list(zip(ids, rows, strict=True))))
    assert sum(r.n_a == 0 for r in found) >= 3 and max(len(g[0]) for t in rows for g in plain_groups(t)) > 2


def test_chunks_do_not_matter(texts, monkeypatch):
    """Counts are those of the corpus however it is cut: as many chunks as documents, or one."""
    rows = [*SAMPLE, *SAMPLE, "the end of the end"]
    whole = ordered(token_alignment.align(texts(*rows).coalesce(1)).collect())
    assert ordered(token_alignment.align(texts(*rows).repartition(len(rows))).collect()) == whole
    assert whole == ordered(plain(list(enumerate(rows))))


def test_empty_table_and_texts_without_tokens(texts):
    assert token_alignment.align(texts("x").limit(0)).collect() == []
    found = token_alignment.align(texts(None, "", "▁")).collect()
    assert {tuple(r)[1:] for r in found} == {(0, 0, 0, 0, 0, 0, "")}


def test_registered_query(spark, tmp_path):
    rows = list(enumerate([*SAMPLE, *ODD[:7]]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_token_alignment(spark, str(tmp_path)).collect()
    want = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[1] else "") for r in plain(rows)]
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(tuple(r[c] for c in columns) for r in found) == want


@pytest.mark.parametrize("letter", [" ", "\n", "a", "7", "=", " ", "é"])
def test_encoder_survives_long_runs(letter):
    """One text of a million equal characters, alone and inside others, has the tokenizer file's own ids."""
    encoder = best_fit.Encoder.of(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (letter * 1_000_000, "word" + letter * 1_000_000 + "word " + letter * 20_000 + "\nend"):
        assert encoder.ids(text) == A.encode(text, add_special_tokens=False).ids


def test_encoder_takes_the_library_for_long_runs_only(monkeypatch):
    encoder = best_fit.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    used = []
    monkeypatch.setattr(encoder, "careful", type("Spy", (), {"encode": lambda self, t, **_: used.append(len(t)) or A.encode(t, add_special_tokens=False)})())
    encoder.ids("word " * 100_000)
    encoder.ids(" " * (encoder.SAFE_RUN - 1) + "x" * 50_000)
    assert not used
    encoder.ids("x" + " " * encoder.SAFE_RUN)
    assert used == [encoder.SAFE_RUN + 1]
    with open(public_tokenizers.path("byte_bpe_50k.json")) as file:
        assert len(encoder.token_bytes()) == len(json.load(file)["model"]["vocab"])


def test_large_groups_are_counted_by_distinct_ids(monkeypatch):
    """The way for groups with many links gives what writing out each link gives."""
    alignment, same = token_alignment.Alignment.of([*SAMPLE, "don't " * 300], *token_alignment.sides(None, None))
    assert same.sum() == len(alignment.counts()[0])
    groups = alignment.groups().unique()

    def links():
        found = Counter()
        for group, pair, n in zip(*(c.tolist() for c in token_alignment.group_links(groups, 32_000)), strict=True):
            found[group, pair] += n
        return found

    monkeypatch.setattr(token_alignment, "FEW", 10**9)
    written = links()
    for few in (0, 1, 3):
        monkeypatch.setattr(token_alignment, "FEW", few)
        assert links() == written
    assert len(written) > 100 and max(written.values()) > 1
