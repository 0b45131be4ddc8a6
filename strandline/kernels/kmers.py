"""k-mers of many rows at once, over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from strandline.alphabet import GROUPS, PROTEIN

#: Kinds of k-mers up to which they are numbered as digits; above, the words found are numbered.
MOST_KINDS = 1 << 16
#: Letters and counters that are worked on at once.
CELLS = 1 << 20


@cache
def _digits(alphabet: str) -> tuple[np.ndarray, np.ndarray]:
    """The digit of each byte (the number of digits: none) and the letter that stands for each digit."""
    groups = GROUPS if alphabet == PROTEIN else ("A", "C", "G", "TU")
    of = np.full(256, len(groups), np.uint8)
    for g, letters in enumerate(groups):
        for c in letters + letters.lower():
            of[ord(c)] = g
    return of, np.frombuffer("".join(g[0] for g in groups).encode(), np.uint8)


@cache
def _words(alphabet: str, k: int) -> np.ndarray:
    """All k-mers of an alphabet, one a row."""
    letters = _digits(alphabet)[1]
    n = np.arange(len(letters) ** k)
    return np.stack([letters[n // len(letters) ** (k - 1 - j) % len(letters)] for j in range(k)], axis=1)


def kmer_counts(residues: pa.Array, k: int, alphabet: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For stretches of rows: the row, the number of the k-mer and its count, by rows and numbers; and the letters of each number.

    A k-mer has a letter of the alphabet, in upper or lower case, at each of its places; others don't count. Numbers hold for
    one stretch, or for all where the alphabet has at most MOST_KINDS.
    """
    residues = residues.cast(pa.large_string())
    at = np.frombuffer(residues.buffers()[1], np.int64)[residues.offset : residues.offset + len(residues) + 1]
    data = np.frombuffer(residues.buffers()[2] or b"", np.uint8)
    digit, letters = _digits(alphabet)
    kinds = len(letters) ** k
    a = 0
    while a < len(residues):
        b = max(a + 1, min(int(np.searchsorted(at, at[a] + CELLS, "right")) - 1, a + max(1, CELLS // kinds) if kinds <= MOST_KINDS else len(residues)))
        d = digit[data[at[a] : at[b]]]
        row = np.repeat(np.arange(a, b, dtype=np.int32), np.diff(at[a : b + 1]))
        a, first = b, a
        m = len(d) - k + 1
        if m < 1:
            continue
        bad = np.concatenate([[0], np.cumsum(d == len(letters), dtype=np.int32)])
        ok = (bad[k:] == bad[:-k]) & (row[:m] == row[k - 1 :])
        if kinds <= MOST_KINDS:
            number = np.zeros(m, np.int32)
            for j in range(k):
                number = number * len(letters) + d[j : j + m]
            key = (row[:m][ok] - first).astype(np.int64) * kinds + number[ok]
            n = np.bincount(key)
            key = np.flatnonzero(n)
            yield first + key // kinds, key % kinds, n[key], _words(alphabet, k)
        else:
            own = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(letters[np.minimum(d, len(letters) - 1)], k)[ok])
            words, number = np.unique(own.view(f"S{k}").ravel(), return_inverse=True)
            key, n = np.unique(row[:m][ok].astype(np.int64) * max(1, len(words)) + number, return_counts=True)
            yield key // max(1, len(words)), key % max(1, len(words)), n, words.view(np.uint8).reshape(len(words), k)


def spelled(numbers: np.ndarray, words: np.ndarray) -> pa.Array:
    n, k = len(numbers), words.shape[1]
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, (n + 1) * k, k, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(words[numbers])))


def shared(row: np.ndarray, kmer: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
    """(rows, rows): the sum over k-mers of the lesser of two rows' counts. kmer: numbers, alike in all rows."""
    out = np.zeros((rows, rows), np.int64)
    kinds, kmer, held = np.unique(kmer, return_inverse=True, return_counts=True)
    place = np.cumsum(held > 1) - 1  # what one row alone has isn't shared
    both = held[kmer] > 1
    row, kmer, n = row[both], place[kmer[both]], n[both]
    order = np.argsort(kmer, kind="stable")
    row, kmer, n = row[order], kmer[order], n[order]
    step = max(1, CELLS // rows)
    for a in range(0, int(place[-1]) + 1 if len(kinds) else 0, step):
        x, y = np.searchsorted(kmer, [a, a + step])
        m = np.zeros((rows, min(step, int(place[-1]) + 1 - a)), np.int32)
        m[row[x:y], kmer[x:y] - a] = n[x:y]
        for i in range(1, rows):
            out[i, :i] += np.minimum(m[:i], m[i]).sum(1)
    return out + out.T
