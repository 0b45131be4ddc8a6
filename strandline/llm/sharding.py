"""Shards of near equal bytes by Karmarkar-Karp differencing over indivisible groups of equal texts.

A partial partition is a vector of k sums. Differencing takes the two with the largest spread and adds them
oppositely ordered (largest to smallest) until one is left. It runs in levels, each a Spark stage: blocks of about
BLOCK groups are differenced to k parts each, the parts of all blocks are the next level's items, and so on
until one block is left. A group that is too large for a part of its block goes up to the next level as it is.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import Workspace, keep, salted_join

SHARDS = 8
#: Items that are differenced in one task, rows that get their slots in one, and most rows of a table that is broadcast (20 bytes each).
BLOCK, LOT, BROADCAST_ROWS = 20_000, 50_000, 500_000


def differencing(vectors: np.ndarray) -> np.ndarray:
    """Combine n vectors of k sums; returns (n, k): for each vector, the final slot of each of its entries."""
    n, k = vectors.shape
    if n == 0:
        return np.zeros((0, k), np.int64)
    order = np.argsort(-vectors, axis=1, kind="stable")
    sums: list = [tuple(v) for v in np.take_along_axis(vectors, order, 1).tolist()]
    # A node's slots are in descending order of sums; links say where each slot of its parts went.
    parts: list[tuple | None] = [None] * n
    heap = [(s[-1] - s[0], i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        sa, sb = sums[a], sums[b]
        added = [sa[j] + sb[k - 1 - j] for j in range(k)]
        rank = sorted(range(k), key=lambda j: -added[j])
        sums.append(tuple(added[j] for j in rank))
        sums[a] = sums[b] = None
        parts.append((a, b, rank))
        heapq.heappush(heap, (sums[-1][-1] - sums[-1][0], len(sums) - 1))
    slots: list = [None] * len(parts)
    slots[heap[0][1]] = list(range(k))
    for i in range(len(parts) - 1, n - 1, -1):
        a, b, rank = parts[i]
        mine, to_a, to_b = slots[i], [0] * k, [0] * k
        slots[i] = None
        for new, j in enumerate(rank):
            to_a[j] = mine[new]
            to_b[k - 1 - j] = mine[new]
        slots[a], slots[b] = to_a, to_b
    out = np.empty((n, k), np.int64)
    np.put_along_axis(out, order, np.array(slots[:n], np.int64), 1)
    return out


def promoted(sizes: np.ndarray, shards: int) -> int:
    """How many of the largest items (sizes descending) are each over an equal share of the items from them on."""
    rest = np.cumsum(sizes[::-1])[::-1]
    even = np.flatnonzero(sizes * shards <= rest)
    return int(even[0]) if len(even) else len(sizes)


def balance(work: Workspace, groups: DataFrame, shards: int, n_groups: int, block: int = BLOCK) -> DataFrame:
    """groups (g binary, size; n_groups of them, each g once) to (g, shard): sums of size over shards are near equal.

    Level by level about `block` items meet in one task. A block's items are differenced to `shards` parts, and these
    are the next level's items, beside those that are too large for a part of their block: they wait for a level where
    they aren't. The last block gives the shards, and every level is followed down again. Nothing is collected.
    """

    def block_of(level: int):
        def inner(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "item"], ascending=[False, True])
            size, last = pdf["size"].to_numpy(), level < 0
            first = 0 if last else promoted(size, shards)
            v = np.zeros((len(pdf) - first, shards), np.int64)
            v[:, 0] = size[first:]
            part = np.append(np.full(first, -1), differencing(v)[:, 0]).astype(np.int32)
            up = [item if p < 0 else f"{level}:{b}:{p}".encode() for item, b, p in zip(pdf["item"], pdf["block"], part, strict=True)]
            return pd.DataFrame({"item": pdf["item"], "size": size, "up": up, "part": part})

        return inner

    now, levels = groups.select(F.col("g").alias("item"), "size"), []
    n = n_groups
    while n > block:
        lots = -(-n // block)
        dealt = now.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(lots)))
        step = dealt.groupBy("block").applyInPandas(block_of(len(levels)), "item binary, size long, up binary, part int")
        levels.append(work.store(step, "level"))
        now = work.store(levels[-1].groupBy(F.col("up").alias("item")).agg(F.sum("size").alias("size")), "items", 64)
        before, n = n, now.count()
        if n > before // 2:  # mostly items that are too large: they meet in blocks as they are
            block *= 2
    last = now.withColumn("block", F.lit(0)).groupBy("block").applyInPandas(block_of(-1), "item binary, size long, up binary, part int")
    to = work.store(last.select("item", F.col("part").alias("shard")), "shards", 1)
    n_to = n
    for level in reversed(levels):
        up = to.select(F.col("item").alias("up"), "shard")
        to = level.join(F.broadcast(up) if n_to <= BROADCAST_ROWS else up, "up").select("item", "shard")
        to = work.store(to, "to") if level is not levels[0] else to
        n_to = BROADCAST_ROWS + 1 if level is levels[0] else to.count()
    return to.select(F.col("item").alias("g"), "shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs (doc_id, text).

    size: UTF-8 bytes plus 1; a null text has none and goes with the empty ones. Rows of equal text go to one
    shard. Slots run from 0 in each shard without gaps, by hash lot and then doc_id; repeated rows get
    slots of their own, null ids come first in their lots. Ties of sums and sizes go by the hash of the text and
    the lower number. Columns besides these two aren't read. No rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    with Workspace(docs.sparkSession, "kk") as work:
        read = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("g"), F.monotonically_increasing_id().alias("_n"))
        rows = work.store(read, "rows")
        groups = work.store(rows.groupBy("g").agg(F.sum("size").alias("size")), "groups")
        placed = salted_join(work, rows, balance(work, groups, shards, groups.count(), block), ["g"], F.col("_n"))
        # Lots of rows by a hash of what is unique to a row, so that no id or text is a large one.
        lots = max(1, -(-rows.count() // LOT))
        placed = work.store(placed.withColumn("_lot", F.pmod(F.xxhash64("doc_id", "_n"), F.lit(lots)).cast("int")), "placed")
        counts = placed.groupBy("shard", "_lot").agg(F.count(F.lit(1)).alias("_c"))
        before = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy("shard").orderBy("_lot")) - F.col("_c")).select("shard", "_lot", "_before")
        slot = F.row_number().over(Window.partitionBy("shard", "_lot").orderBy("doc_id", "g", "_n")) - 1
        before = F.broadcast(before) if lots * shards <= BROADCAST_ROWS else before
        out = placed.withColumn("_at", slot).join(before, ["shard", "_lot"])
        return keep(out.select("doc_id", "size", "text_crc32", "shard", (F.col("_at") + F.col("_before")).cast("long").alias("slot")), "kk-slots")
