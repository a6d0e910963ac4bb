"""Alignment of two tokenizers over the same bytes, as an Arrow pipeline.

Tokens of both sides are flat lists with the document each belongs to. Byte ends are
cumulative sums within a document; an Acero hash join on (document, end) finds the ends
both sides have, and these cut both lists into the same groups. Tokens of one group are
linked, each with each. Which ids a document links is grouped in Arrow, chunk by chunk;
Spark adds up the chunks' counts and sends each chunk the totals of the pairs it holds.

Texts are tokenized once and never shuffled. Most groups occur often, so a chunk keeps each
distinct group once, and its documents as numbers of groups; that is all that waits in the
shared folder for the corpus-wide counts, and what a group adds to a document's sums is
worked out once for all documents of a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oncolens.llm.best_fit import Encoder
from oncolens.llm.common import byte_groups, pick, store

CHUNK_BYTES = 8 << 20  # of texts whose pairs are counted together
SLICE_BYTES = 512 << 10  # of those that are worked on at a time
END_BITS = 36  # of a document-end key
FEW = 64  # links of a group that is written out link by link


class Side:
    """One tokenizer: ids of texts, and each id's bytes, their number and its decimal number, as Arrow arrays."""

    def __init__(self, encode, token_bytes: list[bytes]):
        self.encode = encode
        self.bytes = pa.array(token_bytes, pa.binary())
        self.lengths = pc.binary_length(self.bytes)
        self.decimals = pa.array([str(i) for i in range(len(token_bytes))], pa.string())
        self.dtype = np.dtype("<u2" if len(token_bytes) <= 1 << 16 else "<u4")


@cache
def byte_level(path: str) -> Side:
    """A byte-level tokenizer file; texts get a space before them."""
    encoder = Encoder.of(path)
    return Side(lambda texts: [encoder.ids(" " + t) for t in texts], encoder.token_bytes())


@cache
def piece_model(path: str) -> Side:
    """A piece model, which adds that space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    token_bytes = [
        bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
    ]
    return Side(lambda texts: model.encode(texts, num_threads=1), token_bytes)


def sides(path_a: str | None, path_b: str | None) -> tuple[Side, Side]:
    import public_tokenizers

    return (
        byte_level(path_a or public_tokenizers.path("byte_bpe_50k.json")),
        piece_model(path_b or public_tokenizers.path("piece_bpe_32k.model")),
    )


def running_total(values: pa.Array) -> pa.Array:
    return pc.cumulative_sum(values.cast(pa.int64()))


def ends(lists: pa.ListArray, side: Side) -> tuple[pa.Array, pa.Array]:
    """Document and byte end of every token: a cumulative sum that begins anew with each document."""
    parents = pc.list_parent_indices(lists)
    total = running_total(pc.take(side.lengths, pc.list_flatten(lists)))
    offsets = lists.offsets.to_numpy()
    before = np.concatenate(([0], total.to_numpy()))[offsets[:-1]]
    return parents, pc.subtract(total, pc.take(pa.array(before, pa.int64()), parents))


def joined_bytes(lists: pa.ListArray, side: Side) -> pa.Array:
    tokens = pc.take(side.bytes, pc.list_flatten(lists))
    return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, tokens), b"")


def common_ends(a: pa.ListArray, b: pa.ListArray, side_a: Side, side_b: Side) -> tuple[np.ndarray, np.ndarray]:
    """For the tokens of each side, whether a token of the other ends at the same byte."""
    tables = []
    for lists, side, place in ((a, side_a, "place_a"), (b, side_b, "place_b")):
        doc, end = ends(lists, side)
        key = pc.add(pc.shift_left(doc.cast(pa.int64()), END_BITS), end)
        tables.append(pa.table({"doc_end": key, place: pa.array(np.arange(len(key), dtype=np.int32))}))
    shared = tables[0].join(tables[1], keys="doc_end", join_type="inner", use_threads=False)
    cuts = []
    for place, n in (("place_a", len(tables[0])), ("place_b", len(tables[1]))):
        cut = np.zeros(n, bool)
        cut[shared.column(place).to_numpy()] = True
        cuts.append(cut)
    return cuts[0], cuts[1]


def group_numbers(cuts: np.ndarray) -> np.ndarray:
    """The group of every token, counted over all documents; each document ends with a cut on both sides."""
    return np.cumsum(cuts) - cuts


def written_out(group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray, n: int) -> pa.Table:
    """(group, a, b, links): a row for each link."""
    in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    first_b = np.cumsum(in_b) - in_b
    each = in_b[group_a]  # partners of every A token
    left = np.repeat(np.arange(len(group_a)), each)
    right = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each) + first_b[group_a[left]]
    return pa.table({"group": group_a[left], "a": ids_a[left], "b": ids_b[right], "links": np.ones(len(left), np.int64)})


def met_once(group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray) -> pa.Table:
    """The same of large groups: each distinct A id beside each distinct B id, with the product of their numbers."""
    held = []
    for group, ids, name in ((group_a, ids_a, "a"), (group_b, ids_b, "b")):
        counted = pa.table({"group": group, name: ids}).group_by(["group", name], use_threads=False)
        held.append(counted.aggregate([([], "count_all")]).rename_columns(["group", name, f"n_{name}"]))
    both = held[0].join(held[1], keys="group", join_type="inner", use_threads=False)
    links = pc.multiply(both.column("n_a"), both.column("n_b"))
    return both.select(["group", "a", "b"]).append_column("links", links)


def group_links(groups: pa.StringArray, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, pair and links of described groups, by group; the pair of ids a and b has the number a * n_b + b."""
    halves = pc.split_pattern(groups, "|")
    numbers, ids = [], []
    for k in (0, 1):
        lists = pc.split_pattern(pc.list_element(halves, k), ",")
        numbers.append(pc.list_parent_indices(lists).to_numpy())
        ids.append(pc.list_flatten(lists).cast(pa.int64()).to_numpy())
    (group_a, group_b), (ids_a, ids_b) = numbers, ids
    n_links = np.bincount(group_a, minlength=len(groups)) * np.bincount(group_b, minlength=len(groups))
    few_a, few_b = n_links[group_a] <= FEW, n_links[group_b] <= FEW
    found = [written_out(group_a[few_a], ids_a[few_a], group_b[few_b], ids_b[few_b], len(groups))]
    if not few_a.all():
        found.append(met_once(group_a[~few_a], ids_a[~few_a], group_b[~few_b], ids_b[~few_b]))
    group, a, b, links = (np.concatenate([t.column(c).to_numpy() for t in found]) for c in ("group", "a", "b", "links"))
    order = np.argsort(group, kind="stable")
    return group[order], (a * n_b + b)[order], links[order]


def pairs_by_document(doc: np.ndarray, codes: np.ndarray, group: np.ndarray, pair: np.ndarray) -> pa.Table:
    """(pair, documents): how many documents have some group that links the pair."""
    n = int(group.max(initial=-1)) + 1
    held = np.unique(doc * np.int64(max(n, 1)) + codes)  # a document's distinct groups
    doc, codes = held // max(n, 1), held % max(n, 1)
    size = np.bincount(group, minlength=n)
    first = np.cumsum(size) - size
    each = size[codes]
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first[codes], each)
    linked = pa.table({"doc": np.repeat(doc, each), "pair": pair[at]}).group_by(["doc", "pair"], use_threads=False).aggregate([])
    return linked.group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "documents"])


class Alignment:
    """The tokens of some documents and the groups they fall into."""

    def __init__(self, a: pa.ListArray, b: pa.ListArray, side_a: Side, side_b: Side):
        self.sides = ((a, side_a), (b, side_b))
        self.cuts = common_ends(a, b, side_a, side_b)
        self.doc = pc.list_parent_indices(a).to_numpy()[self.cuts[0]]  # of every group

    @classmethod
    def of(cls, texts: list[str], side_a: Side, side_b: Side) -> tuple[Alignment, np.ndarray]:
        """Of the documents whose tokens give back a space and the text on both sides, and which those are."""
        kind = pa.list_(pa.int32())
        a, b = pa.array(side_a.encode(texts), kind), pa.array(side_b.encode(texts), kind)
        whole = pc.binary_join_element_wise(pa.scalar(b" "), pa.array([t.encode() for t in texts], pa.binary()), b"")
        same = pc.and_(pc.equal(joined_bytes(a, side_a), whole), pc.equal(joined_bytes(b, side_b), whole))
        same = pc.and_(same, pc.greater(pc.binary_length(whole), 1))
        return cls(a.filter(same), b.filter(same), side_a, side_b), same.to_numpy(zero_copy_only=False)

    def groups(self) -> pa.StringArray:
        """``a1,a2|b1``: every group in decimal ids."""
        described = []
        for (lists, side), cuts in zip(self.sides, self.cuts, strict=True):
            offsets = np.concatenate(([0], np.flatnonzero(cuts) + 1)).astype(np.int32)
            decimals = pc.take(side.decimals, pc.list_flatten(lists))
            described.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), decimals), ","))
        return pc.binary_join_element_wise(*described, "|")

    def counts(self) -> np.ndarray:
        """Tokens of A, tokens of B and groups of every document."""
        tokens = [pc.list_value_length(lists).to_numpy() for lists, _ in self.sides]
        return np.stack([*tokens, np.bincount(self.doc, minlength=len(tokens[0]))]).astype(np.int64)


def packed(codes: np.ndarray) -> bytes:
    return pa.compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


CHUNK = "n_a array<long>, n_b array<long>, n_groups array<long>, groups array<string>, codes binary, pairs array<long>, documents array<long>"


def aligned_chunk(texts: list[str], side_a: Side, side_b: Side) -> list[pa.Array]:
    """CHUNK: its documents' counts, its distinct groups, its documents as numbers of these, its pairs."""
    counts, coded, linked, n_b = [], [], [], len(side_b.bytes)
    for part in byte_groups([len(t) for t in texts], SLICE_BYTES):
        alignment, same = Alignment.of(texts[part], side_a, side_b)
        own = np.zeros((3, len(same)), np.int64)
        own[:, same] = alignment.counts()
        counts.append(own)
        coded.append(alignment.groups().dictionary_encode())
        group, pair, _ = group_links(coded[-1].dictionary, n_b)
        linked.append(pairs_by_document(alignment.doc, coded[-1].indices.to_numpy(), group, pair))
    groups = pa.chunked_array(coded).unify_dictionaries()
    codes = np.concatenate([c.indices.to_numpy() for c in groups.chunks])
    pairs = pa.concat_tables(linked).group_by("pair", use_threads=False).aggregate([("documents", "sum")]).sort_by("pair")
    lists = [*np.concatenate(counts, axis=1), groups.chunk(0).dictionary]
    lists = [v if isinstance(v, pa.Array) else pa.array(v) for v in lists]
    whole = [pa.ListArray.from_arrays([0, len(v)], v) for v in lists]
    rest = [pa.ListArray.from_arrays([0, len(pairs)], c.combine_chunks()) for c in pairs.columns]
    pa.default_memory_pool().release_unused()
    return [*whole, pa.array([packed(codes)], pa.binary()), *rest]


def aligned_chunks(docs: DataFrame, path_a: str | None, path_b: str | None) -> DataFrame:
    """A row for each chunk of documents: its number, the documents' ids and CHUNK."""
    ids = T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType))
    schema = T.StructType([T.StructField("chunk", T.LongType()), ids, *T._parse_datatype_string(CHUNK).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = sides(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for chunk in byte_groups([len(t) for t in texts], CHUNK_BYTES):
                own = batch.column(0).slice(chunk.start, chunk.stop - chunk.start)
                head = [pa.array([number]), pa.array([own.to_pylist()], pa.list_(own.type))]
                yield pa.RecordBatch.from_arrays([*head, *aligned_chunk(texts[chunk], side_a, side_b)], schema.names)
                number += 1

    return docs.mapInArrow(run, schema)


def pair_counts(chunks: DataFrame, n_b: int) -> DataFrame:
    """(pair, count, best): documents that link the pair, and whether no other pair of its A id has more."""
    pairs = chunks.select(F.inline(F.arrays_zip("pairs", "documents")))
    counts = pairs.groupBy(F.col("pairs").alias("pair")).agg(F.sum("documents").alias("count"))
    same_a = Window.partitionBy(F.expr(f"pair div {n_b}"))  # an A id has at most as many pairs as B has ids
    return counts.select("pair", "count", (F.col("count") == F.max("count").over(same_a)).alias("best"))


def align(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer_a: str | None = None,
    tokenizer_b: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    A space and the text are cut by a byte-level tokenizer file (A) and a piece model (B).
    Bytes at which tokens of both end part them into groups; ``groups`` lists them as
    ``a1,a2|b1;a3|b2,b3``. Each A token is linked to each B token of its group. A pair of
    ids counts as many documents as link it anywhere in the corpus. ``n_best`` are the
    document's links whose count is the highest that their A id has, ties included;
    ``count_sum`` adds up the counts of its links.

    Texts that are null or empty, or that either side's tokens do not give back byte by
    byte, have no tokens: zeros and an empty ``groups``. Ids may be null, repeat and be of
    any type; every row is a document of its own. An empty table gives no rows.

    A task holds a chunk of texts (``CHUNK_BYTES``, or one longer text), its groups and its
    distinct pairs, and the tokens of ``SLICE_BYTES`` at a time.
    """
    n_b = len(sides(tokenizer_a, tokenizer_b)[1].bytes)
    chunks = store(aligned_chunks(pick(docs, doc_id=id_column, text=text_column), tokenizer_a, tokenizer_b), "aligned")
    held = chunks.select("chunk", F.explode("pairs").alias("pair"))
    told = held.join(pair_counts(chunks, n_b), "pair").select("chunk", "pair", "count", "best")
    own = chunks.withColumnRenamed("chunk", "home").drop("pairs", "documents")
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    id_type = chunks.schema["ids"].dataType.elementType
    schema = T.StructType(
        [T.StructField("doc_id", id_type), *[T.StructField(n, T.LongType()) for n in numbers], T.StructField("groups", T.StringType())]
    )

    def finish(chunk: pa.Table, told: pa.Table) -> pa.Table:
        known, count, best = (told.column(c).to_numpy() for c in ("pair", "count", "best"))
        order = np.argsort(known)
        known, count, best = known[order], count[order], best[order]
        ids, n_a, n_b_, n_groups, groups = (chunk.column(c).combine_chunks().flatten() for c in ("ids", "n_a", "n_b", "n_groups", "groups"))
        group, pair, links = group_links(groups, n_b)
        at = np.searchsorted(known, pair)
        worth = np.zeros((3, len(groups)), np.int64)  # what each group adds to n_links, n_best and count_sum
        for row, value in zip(worth, (links, links * best[at], links * count[at]), strict=True):
            np.add.at(row, group, value)
        codes = unpacked(chunk.column("codes")[0].as_py(), int(pc.sum(n_groups).as_py() or 0))
        edges = np.concatenate(([0], np.cumsum(n_groups.to_numpy())))
        sums = [np.concatenate(([0], np.cumsum(row[codes])))[edges] for row in worth]
        listed = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pc.take(groups, pa.array(codes)))
        columns = [ids, n_a, n_b_, n_groups, *[np.diff(total) for total in sums], pc.binary_join(listed, ";")]
        return pa.table(columns, names=schema.names)

    return own.groupBy("home").cogroup(told.groupBy("chunk")).applyInArrow(finish, schema)
