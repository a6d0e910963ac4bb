"""Sharding by balanced label propagation, in DataFrame operations only."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oncolens.llm.common import cell, pick, store
from oncolens.operators.grouping import join_groups

GROUP_CELLS, ROW_CELLS, REST_CELLS = 16, 16, 512
CELL_ROWS = 1 << 18  # of the rows that fill free slots; beyond REST_CELLS times as many, cells grow with them


def longs(values: list[int]) -> Column:
    return F.lit([int(v) for v in values]) if values else F.array().cast("array<bigint>")


def rank_by_cells(df: DataFrame, cells: Column, n_cells: int, reset: int, order: list[str]) -> tuple[DataFrame, list[int]]:
    """``df`` (stored) with rank, gapless from 0 within every ``reset`` neighbouring cells, and those blocks' sizes.

    Only the cells' counts reach the driver.
    """
    counts = dict(df.groupBy(cells.alias("cell")).count().collect())
    sizes = [counts.get(k, 0) for k in range(n_cells)]
    starts, blocks = [], []
    for k in range(0, n_cells, reset):
        before = [0, *accumulate(sizes[k : k + reset])]
        starts += before[:-1]
        blocks.append(before[-1])
    inside = Window.partitionBy("cell").orderBy(*order)
    ranked = df.withColumn("cell", cells).withColumn("rank", F.row_number().over(inside) - 1 + F.get(longs(starts), "cell"))
    return ranked.drop("cell"), blocks


def preferences(state: DataFrame, quota: int, room: list[int]) -> DataFrame:
    """(grp, targets) for each group in several shards: the shards it may keep, best first, and what each takes in.

    A group's votes are counted per shard, so it has as many rows here as there are
    shards at most. It keeps the shards with most votes, as many as hold it with their room
    or, as others will leave, with three quarters of their quota; each entry says which of the group's movers, numbered, go there.
    """
    votes = state.groupBy("grp", "members", "shard").agg(F.count("*").alias("n"))
    votes = votes.withColumn("cap", F.greatest(F.col("n") + F.greatest(F.get(longs(room), "shard"), F.lit(0)), F.lit(quota * 3 // 4)))
    liked = Window.partitionBy("grp").orderBy(F.desc("n"), F.xxhash64("grp", "shard"), "shard")
    before = F.coalesce(F.sum("cap").over(liked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    votes = votes.withColumn("before", before).withColumn("kept", F.col("before") < F.col("members"))
    need = F.when(F.col("kept"), F.greatest(F.least("cap", F.col("members") - F.col("before")) - F.col("n"), F.lit(0)))
    votes = votes.withColumn("need", F.coalesce(need, F.lit(0)))
    start = F.coalesce(F.sum("need").over(liked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        votes.withColumn("start", start)
        .groupBy("grp")
        .agg(F.collect_list(F.struct("shard", "kept", "need", "start")).alias("targets"), F.sum("need").alias("movers"))
        .where("movers > 0")
    )


def chances(flows: dict[tuple[int, int], int], room: list[int]) -> list[float]:
    """Per shard the share of wishes to go there that its room and those who leave it let in."""
    share = [1.0] * len(room)
    for _ in range(30):
        leave = [sum(n * share[t] for (f, t), n in flows.items() if f == s) for s in range(len(room))]
        come = [sum(n for (_, t), n in flows.items() if t == s) for s in range(len(room))]
        share = [min(1.0, max(0.0, (r + out) / n)) if n else 1.0 for r, out, n in zip(room, leave, come, strict=True)]
    return share


def propagate(state: DataFrame, n_shards: int, quota: int, rounds: int) -> DataFrame:
    """``state`` (row, grp, members, shard, ...) after members moved to the shards most of their group is in.

    Each round proposes moves, then accepts as many as each shard's room and departures
    make way for: whole groups, but single rows of a group that fills an eighth of a
    quota. What is refused tries again. Stops when nobody wants to move. The driver sees
    one count per pair of shards.
    """
    for turn in range(rounds):
        loads = dict(state.groupBy("shard").count().collect())
        room = [quota - loads.get(s, 0) for s in range(n_shards)]
        wishes = preferences(state, quota, room)
        one = F.expr(f"pmod(xxhash64(row, {turn}), movers)")
        asked = join_groups(state, wishes, ["grp"], "left").withColumn("one", one)
        here = F.exists("targets", lambda t: t["kept"] & (t["shard"] == F.col("shard")))
        there = F.filter("targets", lambda t: (t["start"] <= F.col("one")) & (F.col("one") < t["start"] + t["need"]))
        wish = F.when(F.col("targets").isNull() | here, F.col("shard")).otherwise(F.coalesce(F.get(there, 0)["shard"], "shard"))
        asked = store(asked.withColumn("wish", wish).drop("targets", "movers", "one"), "wishes")
        flows = {(r[0], r[1]): r[2] for r in asked.where("wish <> shard").groupBy("shard", "wish").count().collect()}
        if not flows:
            break
        chance = longs([round(c * (1 << 30)) for c in chances(flows, room)])
        unit = F.xxhash64("grp", "wish", F.lit(turn), F.when(F.col("members") * 8 > quota, F.col("row")))
        accepted = F.pmod(unit, F.lit(1 << 30)) < F.get(chance, "wish")
        state = store(asked.withColumn("shard", F.when(accepted, F.col("wish")).otherwise(F.col("shard"))).drop("wish"), "moved")
    return state


def shards(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    n_shards: int = 40,
    rounds: int = 8,
) -> DataFrame:
    """(doc_id, size, text_crc32, grp, shard, slot) per row; shard sizes in rows differ by one at most.

    Rows with equal texts are linked. Linked rows start in shards by hash and move
    towards their group in rounds of label propagation under the shards' quotas; a
    group larger than a quota keeps as few shards as hold it. Then every shard keeps
    what its quota allows, and rows without a link, together with what was too much,
    fill the free slots; a row that has no link costs nothing wherever it is. Slots
    number each shard's rows without gaps from 0.

    Size is the text's UTF-8 bytes plus 16. A null text counts as an empty one, empty
    texts are equal texts. Rows that repeat are rows of their own; null ids are kept. An
    empty table gives no rows. Only counts, one per shard or cell, reach the driver; a cell
    has about ``CELL_ROWS`` rows or fewer.
    """
    columns = pick(docs, doc_id=id_column, text=text_column).withColumn("text", F.coalesce("text", F.lit("")))
    base = columns.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        (F.octet_length("text") + 16).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.sha2("text", 256).alias("grp"),
    )
    base = store(base, "rows")
    members = base.groupBy("grp").agg(F.count("*").alias("members"))
    sized = store(join_groups(base, members, ["grp"], "inner"), "groups")
    total = sized.count()
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]

    names = ["row", "doc_id", "size", "text_crc32", "grp", "members"]
    first = store(sized.where("members > 1").select(*names, cell(n_shards, F.col("row")).alias("shard")), "start")
    linked = propagate(first, n_shards, total // n_shards, rounds)
    cells = GROUP_CELLS * ROW_CELLS
    own = F.col("shard") * cells + cell(GROUP_CELLS, F.col("grp")) * ROW_CELLS + cell(ROW_CELLS, F.col("row"))
    linked, loads = rank_by_cells(linked, own, n_shards * cells, cells, ["grp", "row"])
    fits = F.col("rank") < F.get(longs(quota), "shard")
    kept = [min(q, n) for q, n in zip(quota, loads, strict=True)]
    out = ["doc_id", "size", "text_crc32", "grp", "shard", F.col("rank").alias("slot")]

    rest = sized.where("members = 1").select(*names).unionByName(linked.where(~fits).select(*names))
    rest = store(rest, "rest")
    # Linked rows first and by group, so that they end up side by side; the others after them, in as many cells.
    half = max(REST_CELLS, -(-rest.count() // (CELL_ROWS * ROW_CELLS)) * ROW_CELLS)
    place = F.when(F.col("members") > 1, cell(half // ROW_CELLS, F.col("grp")) * ROW_CELLS + cell(ROW_CELLS, F.col("row")))
    place = place.otherwise(half + cell(half, F.col("row")))
    rest, _ = rank_by_cells(rest, place, 2 * half, 2 * half, ["grp", "row"])
    free = longs([0, *accumulate(q - k for q, k in zip(quota, kept, strict=True))][:-1])
    shard = F.size(F.filter(free, lambda start: start <= F.col("rank"))) - 1
    rest = rest.withColumn("shard", shard).withColumn("rank", F.col("rank") - F.get(free, "shard") + F.get(longs(kept), "shard"))
    return linked.where(fits).select(*out).unionByName(rest.select(*out))
