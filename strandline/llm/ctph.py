"""Context-triggered piecewise hashing: signatures of chunks whose borders a rolling hash sets.

A hash of the last 7 bytes ends a chunk where it is -1 modulo the block size; each chunk gives one of 64
signs. The block size is 3 * 2^i, the smallest for which 64 chunks may cover the text, halved while the
signature is shorter than 8 (texts of like size then keep like blocks). A fingerprint is `block:signature:signature at twice the block`. Two
fingerprints are compared where their block sizes are equal or one is twice the other: by the edit
distance (insertions and deletions) of the signatures of the same block size, if these share a run of
signs (7, or a quarter of the shorter one). Everything runs over many texts at once in numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import lots_of, prepare
from strandline.llm.wordhash import U64, span_hashes

SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_SIGNS = np.frombuffer(SIGNS.encode(), np.uint8)
WINDOW, LEAST_BLOCK, LENGTH = 7, 3, 64
_BYTE = np.random.default_rng(77).integers(1, 1 << 32, 256, dtype=np.int64).astype(np.uint32)
_BYTE[0] = 0  # texts are joined with zero bytes
_STEP = np.uint32(0x01000193)
BLOCK_BYTES = 1 << 20


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the last WINDOW bytes at each place."""
    t = _BYTE[data]
    out = t.copy()
    factor = np.uint32(1)
    with np.errstate(over="ignore"):
        for j in range(1, WINDOW):
            factor = factor * _STEP
            out[j:] += t[:-j] * factor
        out ^= out >> np.uint32(15)
        out *= np.uint32(0x2C1B3C6D)
        out ^= out >> np.uint32(12)
    return out


def _first_blocks(sizes: np.ndarray) -> np.ndarray:
    k = np.ceil(np.log2(np.maximum(sizes, 1) / (LEAST_BLOCK * LENGTH))).clip(0).astype(np.int64)
    k += (LEAST_BLOCK * LENGTH << k) < sizes
    return LEAST_BLOCK << k


def _signature(data: np.ndarray, ends: np.ndarray, lo: int, hi: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of data[lo:hi], at most so many; ends: places of borders."""
    stop = ends[: most - 1] + 1
    if not len(stop) or stop[-1] < hi:
        stop = np.append(stop, hi) if hi > lo else stop
    return np.append(lo, stop[:-1])[: len(stop)], stop


def fingerprints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block sizes, and signatures at the block and twice the block as sign codes padded with 64 (n x 64)."""
    n = len(texts)
    pad = b"\0" * WINDOW
    data = np.frombuffer(pad.join([b"", *texts]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    lo = np.cumsum(sizes + WINDOW) - sizes
    hi = lo + sizes
    r = rolling(data)
    block = _first_blocks(sizes)
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    todo = np.arange(n)
    while len(todo):
        again = []
        for b in np.unique(block[todo]).tolist():
            for i in todo[block[todo] == b].tolist():
                own = np.flatnonzero(r[lo[i] : hi[i]] % np.uint32(b) == np.uint32(b - 1))
                found[i] = own + lo[i]
                if len(own) + 1 < LENGTH // 8 and b > LEAST_BLOCK:
                    block[i] = b // 2
                    again.append(i)
        todo = np.array(again, np.int64)
    spans: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(n):
        e = found[i]
        spans.append(_signature(data, e, lo[i], hi[i], LENGTH))
        twice = np.uint32(2 * block[i])
        spans.append(_signature(data, e[r[e] % twice == twice - np.uint32(1)], lo[i], hi[i], LENGTH))
    starts, ends = (np.concatenate([s[k] for s in spans]).astype(np.int64) for k in (0, 1))
    count = np.fromiter((len(s[0]) for s in spans), np.int64, 2 * n)
    codes = (span_hashes(data, starts, ends) >> U64(58)).astype(np.uint8)
    out = np.full((2 * n, LENGTH), 64, np.uint8)
    row = np.repeat(np.arange(2 * n), count)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = codes
    return block, out[0::2], out[1::2]


def as_strings(block: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[str]:
    n1, n2 = (one < 64).sum(1).tolist(), (two < 64).sum(1).tolist()
    signs = np.append(_SIGNS, 0).astype(np.uint8)
    s1, s2 = signs[one], signs[two]
    return [f"{b}:{s1[i, : n1[i]].tobytes().decode()}:{s2[i, : n2[i]].tobytes().decode()}" for i, b in enumerate(block.tolist())]


def signature_likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """2 * (longest common subsequence) / (both lengths), or 0 without a long enough common run; bit-parallel."""
    n = len(a)
    rows = np.arange(n)
    masks = np.zeros((n, 65), U64)
    for i in range(LENGTH):
        masks[rows, a[:, i]] |= U64(1 << i)
    masks[:, 64] = 0
    la, lb = (a < 64).sum(1), (b < 64).sum(1)
    gate = np.maximum(1, np.minimum(7, np.minimum(la, lb) // 4))
    v = np.full(n, ~U64(0))
    runs = np.zeros((8, n), U64)
    runs[0] = ~U64(0)
    met = np.zeros((8, n), bool)
    with np.errstate(over="ignore"):
        for j in range(LENGTH):
            m = masks[rows, b[:, j]]
            u = v & m
            v = (v + u) | (v & ~m)
            for k in range(7, 0, -1):
                runs[k] = m & ((runs[k - 1] << U64(1)) if k > 1 else ~U64(0))
            met |= runs > 0
    keep = np.where(la >= 64, ~U64(0), (U64(1) << np.minimum(la, 63).astype(U64)) - U64(1))
    lcs = np.bitwise_count(~v & keep).astype(np.float64)
    score = 2 * lcs / np.maximum(la + lb, 1)
    return np.where(met[gate, rows], score, 0.0)


def likeness(x: tuple[np.ndarray, np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints; 1 for equal ones."""
    (bx, x1, x2), (by, y1, y2) = x, y
    out = np.zeros(len(bx))
    for rows, pairs in ((bx == by, ((x1, y1), (x2, y2))), (bx == 2 * by, ((x1, y2),)), (2 * bx == by, ((x2, y1),))):
        if rows.any():
            out[rows] = np.max([signature_likeness(p[rows], q[rows]) for p, q in pairs], axis=0)
    same = (bx == by) & (x1 == y1).all(1) & (x2 == y2).all(1)
    out[same] = 1.0
    return out


def with_next(docs: DataFrame, lots: int) -> DataFrame:
    """docs (doc_id long, text) dealt in ranges of ascending id; in each, the row after the last is a copy
    (_copy = 1) of the next range's first, and of the first of all after the last of all."""
    head = docs.agg(F.expr(f"percentile_approx(doc_id, array({', '.join(str(i / lots) for i in range(1, lots))}), 10000)").alias("q") if lots > 1 else F.lit(None).alias("q"), F.min("doc_id").alias("lo"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    bounds = [x for x in sorted(set(head["q"] or [])) if head["nulls"] or x > head["lo"]]
    at = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<bigint>")
    pid = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(at, lambda b: b <= F.col("doc_id"))))
    first = F.col("doc_id").isNull() if head["nulls"] else F.col("doc_id") == head["lo"]
    none = F.lit(None).cast("int")
    copies = F.array(
        F.struct(F.col("_pid").alias("pid"), F.lit(0).alias("copy")),
        F.struct(F.when(F.coalesce(F.array_contains(at, F.col("doc_id")), F.lit(False)), F.col("_pid") - 1).otherwise(none).alias("pid"), F.lit(1).alias("copy")),
        F.struct(F.when(first, F.lit(len(bounds))).otherwise(none).alias("pid"), F.lit(1).alias("copy")),
    )
    dealt = docs.withColumn("_pid", pid.cast("int")).withColumn("_to", F.explode(F.filter(copies, lambda c: c["pid"].isNotNull())))
    dealt = dealt.select("doc_id", "text", F.col("_to.pid").alias("_pid"), F.col("_to.copy").alias("_copy"))
    return dealt.repartition(max(1, lots // 4), "_pid").sortWithinPartitions("_pid", "_copy", F.col("doc_id").asc_nulls_first(), "text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as many first ones
    (or all) of the next text in ascending doc_id. A null text is empty; null ids come first; rows that
    share an id follow each other in the order of their texts. A lone row is its own next.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    lots = 4 * lots_of(docs)

    def out(ids: list, texts: list[str], copy: list[int]) -> Iterator[pa.RecordBatch]:
        """All rows but the last, which only is what follows."""
        lo = 0
        while lo < len(ids) - 1:
            hi, held = lo, 0
            while hi < len(ids) - 1 and (hi == lo or held < BLOCK_BYTES):
                held += 2 * len(texts[hi])
                hi += 1
            own, following = texts[lo : hi + 1], [t.encode() for t in texts[lo : hi + 1]]
            edited = []
            for a, b in zip(own[:-1], own[1:], strict=True):
                k = len(a) // 2
                edited.append((a[: len(a) - k] + b[:k]).encode())
            plain, after = fingerprints(following), fingerprints(edited)
            mine, nxt = tuple(x[:-1] for x in plain), tuple(x[1:] for x in plain)
            real = np.array([c == 0 for c in copy[lo:hi]])
            cols = [
                pa.array(ids[lo:hi], pa.int64()),
                pa.array([len(t) for t in own[:-1]], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                pa.array(as_strings(*mine)),
                pa.array(as_strings(*after)),
                pa.array(likeness(mine, after)),
                pa.array(likeness(mine, nxt)),
            ]
            yield pa.RecordBatch.from_arrays(cols, NAMES).filter(pa.array(real))
            lo = hi

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        copy: list[int] = []
        for b in batches:
            ids += b.column("doc_id").to_pylist()
            texts += b.column("text").to_pylist()
            copy += b.column("_copy").to_pylist()
            yield from out(ids, texts, copy)
            ids, texts, copy = ids[-1:], texts[-1:], copy[-1:]

    return with_next(rows, lots).mapInArrow(kernel, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
