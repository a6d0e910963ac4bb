"""Language identification by cross-parsing against suffix automata of labelled text.

A text is cut into the longest pieces that occur in a language's reference, one after the
other; the language that needs the fewest, normalised, wins. References are running text
and pieces cross words, so word order and endings count. Texts are read as UTF-8 bytes. The
automaton of a reference is kept as a dense table of what every byte does in every state,
through which a task walks many texts under all languages at once.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oncolens.llm.common import byte_groups, held_out, pick

LETTER = regex.compile(r"\p{L}")
WORD = re.compile(r"[^\W\d_]+")  # letters, and the few other numbers that are no decimal digits
UNKNOWN = "und"
PIECE = 2_000
WIDE = 24  # texts that are worth a step of all together
BATCH_BYTES = 16 << 20


def running(text: str) -> list[str]:
    """The text's words in lower case, as they stand in a reference: one after the other, a blank between."""
    return WORD.findall(text.lower())


def as_read(words: list[str]) -> bytes:
    return f" {' '.join(words)} ".encode()


def automaton(text: bytes) -> list[dict[int, int]]:
    """Suffix automaton: the transitions of every state; from state 0 any substring of ``text`` can be walked."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        state = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = state
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return following


def transitions(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(columns of the 256 bytes, table) of a reference: what a byte does in a state.

    An entry is the place of the next state's row, times 4, plus the phrases that end: none
    where the match goes on; where it does not, the match so far and, if the reference
    lacks the byte, the byte by itself. Column 0 is for bytes the reference lacks.
    """
    following = automaton(text)
    letters = sorted(following[0])
    columns, n = np.zeros(256, np.int64), len(letters) + 1
    columns[letters] = np.arange(1, n)
    begin = np.array([1, *(following[0][c] * n * 4 for c in letters)], np.int64)
    table = np.tile(begin, (len(following), 1))
    table[1:] += 1
    rows = np.repeat(np.arange(len(following)), [len(f) for f in following])
    table[rows, columns[[c for f in following for c in f]]] = np.array([t for f in following for t in f.values()], np.int64) * n * 4
    return columns, table.ravel()


class Parser:
    """Phrases of texts under every language."""

    made: dict[tuple, Parser] = {}

    def __init__(self, references: tuple[tuple[str, str], ...]):
        made = [transitions(text.encode()) for _, text in references]
        sizes = [len(table) for _, table in made]
        self.start = np.cumsum([0, *sizes[:-1]])
        total = sum(sizes)
        self.kind = np.int32 if total < 1 << 29 else np.int64
        self.columns = np.stack([columns for columns, _ in made]).astype(self.kind)
        self.table = np.empty(total, self.kind)
        for first, (_, table) in zip(self.start, made, strict=True):
            self.table[first : first + len(table)] = table + 4 * first
        self.cost = np.array([math.log2(len(text.encode()) + 1) for _, text in references])

    @classmethod
    def of(cls, references: tuple[tuple[str, str], ...]) -> Parser:
        if references not in cls.made:
            cls.made.clear()
            cls.made[references] = cls(references)
        return cls.made[references]

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """How many longest matches make up each text (rows) under each language (columns)."""
        raw = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        first = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        state = np.repeat(self.start[:, None], len(texts), axis=1).astype(self.kind)
        found = np.zeros(state.shape, np.int64)
        wide = int(lengths[WIDE - 1]) if len(lengths) >= WIDE else 0
        active = np.searchsorted(-lengths, -np.arange(wide), side="left").tolist()  # texts longer than each place
        for t, k in enumerate(active):
            step = self.table[state[:, :k] + self.columns[:, raw[first[:k] + t]]]
            found[:, :k] += step & 3
            state[:, :k] = step >> 2
        for k in np.flatnonzero(lengths > wide).tolist():  # a few texts are left: one after the other
            rest, table = raw[first[k] + wide : first[k] + lengths[k]], self.table.data
            for lang, columns in enumerate(self.columns):
                at, n = int(state[lang, k]), 0
                for c in columns[rest].tolist():
                    step = table[at + c]
                    n += step & 3
                    at = step >> 2
                state[lang, k] = at
                found[lang, k] += n
        found += state != self.start[:, None]
        out = np.empty(found.T.shape, np.int64)
        out[order] = found.T
        return out

    def bits(self, texts: list[str]) -> np.ndarray:
        """Normalised phrases of each text under each language: bits per byte."""
        read = [as_read(running(t)) for t in texts]
        return self.phrases(read) * self.cost / np.array([len(r) for r in read])[:, None]


def cut_at_words(words: list[str], most_bytes: int) -> list[str]:
    """Running text of at most ``most_bytes`` in pieces of about ``PIECE``; a longer word is a piece of its own."""
    out, size, total = [[]], 0, 0
    for word in words:
        width = len(word.encode()) + 1
        if total and total + width > most_bytes:
            break
        if size and size + width > PIECE:
            out.append([])
            size = 0
        out[-1].append(word if width <= most_bytes else word.encode()[:most_bytes].decode(errors="ignore"))
        size += width
        total += width
    return [" ".join(piece) for piece in out if piece]


def pieces(rows: DataFrame, most_bytes: int) -> DataFrame:
    """(lang, rank, k, piece): each text of ``rows`` (lang, rank, text) as running words, cut into pieces.

    Of one text its first ``most_bytes`` are enough: no language takes more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, rank, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cut = cut_at_words(running(text), most_bytes)
                columns = [[lang] * len(cut), [rank] * len(cut), list(range(len(cut))), cut]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns, kinds)], ["lang", "rank", "k", "piece"])

    return rows.mapInArrow(run, "lang string, rank long, k long, piece string")


def learn(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    folds: int = 3,
    fold: int = 1,
    docs_per_language: int = 120,
    reference_bytes: int = 60_000,
    most_languages: int = 50,
) -> tuple[tuple[str, str], ...]:
    """(language, reference text) from labelled rows outside the held-out fold.

    The sample has about ``docs_per_language`` documents a language, chosen by a hash of
    the id, whatever their length. A reference is running text of the sample up to
    ``reference_bytes``: the first ``PIECE`` characters of every document before the second
    of any, in the order of the hash, so that many documents speak where there are many. It
    is cut to that in Spark, so only the references reach the driver. Rows without an id or
    language teach nothing. Of more than ``most_languages`` values of lang, those with most
    rows are learnt; a task's tables take some 15 MB a language.
    """
    rows = pick(docs, id=id_column, text=text_column, lang=lang_column).where(
        "id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL"
    )
    rows = rows.where(~held_out(F.col("id"), folds, fold)).withColumn("rank", F.xxhash64("id"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
    share = F.least(F.lit(1.0), docs_per_language / F.col("count")) * (1 << 30)
    shares = counts.select("lang", share.cast("long").alias("share"))  # at most ``most_languages`` rows
    sample = rows.join(F.broadcast(shares), "lang").where(F.pmod("rank", F.lit(1 << 30)) < F.col("share"))
    cut = pieces(sample.select("lang", "rank", "text"), reference_bytes)
    order = Window.partitionBy("lang").orderBy("k", "rank", "piece").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("piece") + 1).over(order), F.lit(0))
    taken: dict[str, list[tuple]] = defaultdict(list)
    for row in cut.withColumn("before", before).where(F.col("before") < reference_bytes).collect():
        taken[row["lang"]].append((row["k"], row["rank"], row["piece"]))
    words = {lang: " ".join(piece for *_, piece in sorted(taken[lang])).split(" ") for lang in sorted(taken)}
    return tuple((lang, " ".join(["", *cut_at_words(own, reference_bytes), ""])) for lang, own in words.items())


def predicted(
    docs: DataFrame, references: tuple[tuple[str, str], ...], id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, lang_pred, score) per row, from the whole text.

    The language with the fewest bits per byte wins; of equals, the first by name. The
    score is its share under a soft minimum of the bits. A null text, one without a letter,
    and every text when nothing was learnt are ``und`` with score 0.
    """
    columns = pick(docs, doc_id=id_column, text=text_column)
    schema = T.StructType([columns.schema["doc_id"], *T._parse_datatype_string("lang_pred string, score double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if references:
                parser = Parser.of(references)
                for part in byte_groups([len(t) for t in texts], BATCH_BYTES):
                    own = [k for k in range(part.start, part.stop) if LETTER.search(texts[k])]
                    if own:
                        bits = parser.bits([texts[k] for k in own])
                        best = bits.argmin(axis=1)
                        langs[own] = [references[b][0] for b in best]
                        scores[own] = 1 / np.exp(-8 * (bits - bits.min(axis=1, keepdims=True))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], schema.names)

    return columns.mapInArrow(run, schema)
