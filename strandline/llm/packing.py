"""Best-fit packing by minimum bin slack: token pieces into as few sequences of a fixed length as possible.

Pieces of one length are interchangeable, so the whole problem is the number of pieces of each length: at
most `capacity` counts, whatever the corpus holds. Minimum bin slack runs on these counts: the longest
length left opens a bin, a subset-sum over bitsets finds the fullest set of other lengths that fits
beside it, and the combination is used as often as the counts allow, then removed. Each use empties a
length, so there are at most `capacity` distinct combinations. Pieces then get their place from their rank
among those of their length, which is counted in lots of about LOT pieces, so no length gathers in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import Workspace, extended, keep, prepare, row_blocks, text_buffer
from strandline.llm.tokens import encoder, tokenizer_path

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces of one length that are numbered in one task; the number of tasks for a length follows from it.
LOT = 50_000


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of which of these lengths (descending) fill `room` best: exact subset-sum over bitsets.

    Stops at the first length with which the room can be filled to the last token.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in lengths:
        if n > room:
            continue
        left, size = min(counts[n], room // n), 1
        while left:  # binary splitting: any number up to `left` is a sum of these parts
            take = min(size, left)
            steps.append((n, take, reach))
            reach |= (reach << (n * take)) & mask
            left -= take
            size *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            used[n] = used.get(n, 0) + take
            at -= n * take
    return used


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Combinations as (times used, {length: pieces}); together they use every piece once."""
    counts = {n: c for n, c in counts.items() if c > 0}
    order = sorted(counts, reverse=True)
    plan = []
    while order:
        first = order[0]
        counts[first] -= 1
        used = fullest([n for n in order if counts[n]], counts, capacity - first)
        counts[first] += 1
        used[first] = used.get(first, 0) + 1
        times = min(counts[n] // k for n, k in used.items())
        plan.append((times, used))
        for n, k in used.items():
            counts[n] -= times * k
        order = [n for n in order if counts[n]]
    return plan


def plan_table(plan: list[tuple[int, dict[int, int]]], capacity: int) -> dict[str, np.ndarray]:
    """For each length, runs of ranks and where they go, sorted by (length, first rank)."""
    rank = np.zeros(capacity + 1, np.int64)
    rows, base = [], 0
    for times, used in plan:
        offset = 0
        for n in sorted(used, reverse=True):
            rows.append((n, rank[n], used[n], base, offset))
            rank[n] += times * used[n]
            offset += n * used[n]
        base += times
    t = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {k: t[:, i].copy() for i, k in enumerate(("length", "first", "per", "base", "offset"))} | {"start": np.searchsorted(t[:, 0], np.arange(capacity + 2))}


def pieces(docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of documents (doc_id, text): doc_id, piece, start, length, ids_crc32.

    A null text is empty and gives one piece with only the end id. Only texts over the capacity are cut.
    """
    path = path or tokenizer_path(TOKENIZER)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            for lo, hi in row_blocks(off):
                ids, n = encoder(path, True).encode(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                ends = np.cumsum(n)
                out: list[tuple[int, int, int, int]] = []
                for r, (stop, size) in enumerate(zip(ends.tolist(), n.tolist(), strict=True)):
                    own = np.append(ids[stop - size : stop], np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(own), capacity):
                        part = own[at : at + capacity]
                        out.append((r, at, len(part), zlib.crc32(part)))
                t = np.array(out, np.int64).reshape(-1, 4)
                rows = batch.column("doc_id").slice(lo, hi - lo).take(pa.array(t[:, 0]))
                yield pa.RecordBatch.from_arrays([rows, pa.array((t[:, 1] // capacity).astype(np.int32)), pa.array(t[:, 1]), pa.array(t[:, 2]), pa.array(t[:, 3])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(work: Workspace, parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (with length in 1..capacity, stored: read several times) plus sequence_id and offset.

    Ties: pieces of one length go in any fixed order. Null ids and repeated rows are pieces like others, each with
    a place of its own. Columns named _n, _lot, _rank, sequence_id or offset give way; others stay. No rows give no rows.
    """
    parts = parts.drop("_lot", "_rank", "sequence_id", "offset")
    per_length = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = parts.sparkSession.sparkContext.broadcast(plan_table(minimum_bin_slack(per_length, capacity), capacity))
    lots = max(1, -(-max(per_length.values(), default=0) // LOT))
    salted = work.store(parts.withColumn("_n", F.monotonically_increasing_id()), "numbered").withColumn("_lot", F.pmod(F.xxhash64("_n"), F.lit(lots)).cast("int"))
    counts = salted.groupBy("length", "_lot").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy("length").orderBy("_lot")) - F.col("_c")).select("length", "_lot", "_before")
    rank = F.row_number().over(Window.partitionBy("length", "_lot").orderBy("_n"))
    ranked = salted.withColumn("_rank", rank - 1).join(before, ["length", "_lot"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    names = [*parts.columns, "_rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for b in batches:
            length, r = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            lo, hi = p["start"][length], p["start"][length + 1]
            # runs are sorted by (length, first): one search over both
            step = int(max(p["first"].max(initial=0), r.max(initial=0))) + 1
            run = np.searchsorted(p["length"] * step + p["first"], length * step + r, "right") - 1
            assert ((run >= lo) & (run < hi)).all()
            at = r - p["first"][run]
            seq = p["base"][run] + at // p["per"][run]
            offset = p["offset"][run] + at % p["per"][run] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(offset)], [*names[:-1], "sequence_id", "offset"])

    return ranked.select(*names).mapInArrow(place, extended(parts, "sequence_id long, offset long"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """All documents' pieces with their sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset. See pieces() and pack()."""
    with Workspace(docs.sparkSession, "packing") as work:
        return keep(pack(work, work.store(pieces(docs, path, capacity=capacity), "pieces"), capacity), "packed")
