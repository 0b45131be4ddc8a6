"""Words of many texts at once, as byte spans and 64-bit hashes, with numpy over Arrow buffers.

A word's hash is a polynomial of its bytes modulo 2^64, read off prefix sums and mixed. Two different
words among ten million share a hash with a probability under 10^-5.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Bytes that part words in the contracts with [^\\x20\\x09-\\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, every other byte to itself.
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32

#: Kinds of bytes for pieces: 0 white space, 1 ASCII letter, 2 digit, 3 other ASCII, 4 what may go with either side.
KIND = np.full(256, 3, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[65:91] = KIND[97:123] = 1
KIND[48:58] = 2
KIND[128:] = KIND[39] = 4

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_BYTE = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)
_powers: dict[str, np.ndarray] = {}


def _pow_table(kind: str, base: int, n: int) -> np.ndarray:
    t = _powers.get(kind)
    if t is None or len(t) < n:
        size = max(n, 1 << 20) + 1
        t = np.full(size, base, U64)
        t[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(t, out=t)
        _powers[kind] = t
    return t[:n]


def mapped(data: np.ndarray, to: np.ndarray) -> np.ndarray:
    """to[data] for bytes and a table of 256 of them; an index by numpy would first widen each byte to eight."""
    return np.frombuffer(data.tobytes().translate(to.tobytes()), to.dtype)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x = x * U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] for each span; data is uint8."""
    n = len(data)
    with np.errstate(over="ignore"):
        prefix = np.empty(n + 1, U64)
        prefix[0] = 0
        x = _BYTE[data]
        x *= _pow_table("up", _P, n)
        np.cumsum(x, out=prefix[1:])
        h = (prefix[ends] - prefix[starts]) * _pow_table("down", _P_INV, n + 1)[starts]
    return mix(h)


def word_spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and where each row's words begin in them (rows + 1)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    np.logical_not(mapped(data, sep), out=inside[1:-1])
    edge = np.unique(offsets)
    start = inside[1:-1] & ~inside[:-2]
    at = edge[edge < n]
    start[at] |= inside[at + 1]
    end = inside[1:-1] & ~inside[2:]
    at = edge[edge > 0] - 1
    end[at] |= inside[at + 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def piece_spans(data: np.ndarray, offsets: np.ndarray, spaces: bool, whole_rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows cut before white-space runs and where ASCII letters, digits and other ASCII signs meet.

    An apostrophe and bytes outside ASCII stay with both neighbours. spaces: a run goes with what follows
    it; otherwise white space is left out. Rows of the mask whole_rows aren't cut.
    """
    n = len(data)
    kind = KIND[data]
    start = np.zeros(n + 1, bool)
    if n:
        a, b = kind[:-1], kind[1:]
        np.logical_and.reduce([a != b, a > 0, b < 4, (a < 4) | (b == 0)], out=start[1:n])
        if not spaces:
            start[1:n] = (start[1:n] & (b > 0)) | ((a == 0) & (b > 0))
        if whole_rows is not None:
            for r in np.flatnonzero(whole_rows):
                start[offsets[r] : offsets[r + 1]] = False
    edge = offsets[offsets < n]
    start[edge] = (kind[edge] > 0) | spaces
    if whole_rows is not None:
        start[offsets[:-1][whole_rows]] = True
    start[n] = False
    starts = np.flatnonzero(start)
    if spaces:
        ends = np.append(starts[1:], n) if len(starts) else starts
    else:
        stop = np.zeros(n + 1, bool)
        stop[1:n] = (kind[1:] == 0) & (kind[:-1] > 0)
        stop[n] = n > 0 and kind[-1] > 0
        stop |= start
        stop[offsets] = True
        if whole_rows is not None:
            for r in np.flatnonzero(whole_rows):
                stop[offsets[r] + 1 : offsets[r + 1]] = False
        marks = np.flatnonzero(stop)
        ends = marks[np.searchsorted(marks, starts, "right")] if len(starts) else starts
    return starts, ends, np.searchsorted(starts, offsets)
