"""Column functions over the scores of residues, by numpy: one pass over the letters of a batch of rows, without a value for each in the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, ShortType

from strandline.alphabet import GAPS


#: What a gap is, by code.
_GAP = np.zeros(128, bool)
_GAP[[ord(g) for g in GAPS]] = True


def _codes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letters of all rows, a byte each where all are ASCII, and offsets (rows + 1, from 0); null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, offsets, values = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8)[off[0] : off[-1]] if values is not None else np.zeros(0, np.uint8)
    if len(data) and data.max() > 127:
        start = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # letters before each byte
        return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), start[off - off[0]]
    return data, off - off[0]


def scores_of(marks: pa.Array, offset: pa.Array) -> pa.Array:
    """Marks less an offset, at least 0; null for null."""
    codes, off = _codes(marks)
    less = np.asarray(pc.fill_null(offset, 0), np.int32)
    same = len(less) == 0 or (less == less[0]).all()
    if same and codes.dtype == np.uint8 and len(less):  # one score for each code
        flat = np.clip(np.arange(128, dtype=np.int64) - less[0], 0, None)
        out = flat[codes] if flat.max() > np.iinfo(np.int16).max else flat.astype(np.int16)[codes]
    else:
        out = np.maximum(codes.astype(np.int64) - np.repeat(less.astype(np.int64), np.diff(off)), 0)
    if out.dtype != np.int16:
        if len(out) and out.max() > np.iinfo(np.int16).max:
            raise OverflowError("a score over 32767")
        out = out.astype(np.int16)
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(out), mask=marks.is_null() if marks.null_count else None)


def _sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of x over each row, whole numbers."""
    some = off[1:] > off[:-1]
    out = np.zeros(len(off) - 1, np.int64)
    out[some] = np.add.reduceat(x, off[:-1][some], dtype=np.int64) if some.any() else 0
    return out


def mean_of(residues: pa.Array, quality: pa.Array) -> pa.Array:
    """Mean score over positions that aren't gaps; null without any, or where one has no score."""
    codes, off = _codes(residues)
    own = ~(_GAP[codes] if codes.dtype == np.uint8 else np.isin(codes, np.flatnonzero(_GAP)))
    at = np.asarray(quality.offsets).astype(np.int64) if len(quality) else np.zeros(1, np.int64)
    flat = quality.values.slice(at[0], at[-1] - at[0])
    lost = np.asarray(pc.is_null(flat)) if flat.null_count else None
    q, at = np.asarray(pc.fill_null(flat, 0)), at - at[0]
    there = ~np.asarray(pc.or_(pc.is_null(residues), pc.is_null(quality)))
    if not np.array_equal(off, at):  # rows with more or fewer scores than letters: a letter beyond them has none
        n, m = np.diff(off), np.diff(at)
        k = np.arange(len(codes)) - np.repeat(off[:-1], n)
        has = k < np.repeat(m, n)
        place = (np.repeat(at[:-1], n) + k)[has]
        missing, spread = ~has, np.zeros(len(codes), q.dtype)
        spread[has] = q[place]
        if lost is not None:
            missing[has] = lost[place]
        q, lost = spread, missing
    n = _sums(own, off)
    ok = there & (n > 0)
    if lost is not None:
        ok &= _sums(lost & own, off) == 0
    total = _sums(np.where(own, q, 0), off).astype(float)
    return pa.array(np.divide(total, n, out=np.zeros(len(n)), where=n > 0), pa.float64(), mask=~ok)


mean_quality = arrow_udf(mean_of, DoubleType())
scores = arrow_udf(scores_of, ArrayType(ShortType()))
