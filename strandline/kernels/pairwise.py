"""Affine-gap alignment of two sequences, global and local, by anti-diagonals in single precision."""

from __future__ import annotations

import numpy as np

NEG = np.float32(-1e18)


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("ascii", "replace"), np.uint8) & 127


def fill(S: np.ndarray, vo: np.ndarray, ve: np.ndarray, ho: np.ndarray, he: np.ndarray, ends: list[tuple[int, int]], local: bool = False):
    """Choices and last scores of a batch of problems, by anti-diagonals.

    S is (batch, n, m); vo, ve are penalties by column (batch, m + 1), ho, he by row (batch, n + 1); a
    problem ends at its cell in `ends`. Lanes: M, X (gap in b), Y (gap in a). A choice holds for M the lane
    before (0, 1, 2; 3 starts a local alignment), and for X and Y whether the gap goes on (3) or the lane it
    was opened from. Ties go to M, then X, then Y; a gap goes on only if that is strictly better. Returns
    the choices [diagonal, problem, row] as m | x << 2 | y << 4 and, for each problem, the scores of the
    three lanes at its end, or the best local score and its cell (the first by rows).
    """
    B, n, m = S.shape
    flat = S.reshape(B, n * m)
    code = np.zeros((n + m + 1, B, n + 1), np.uint8)
    M, X, Y, M1, X1, Y1, M2, X2, Y2 = (np.full((B, n + 1), NEG, np.float32) for _ in range(9))
    M1[:, 0] = 0
    last = np.full((B, 3), NEG, np.float32)
    top = np.zeros((B, 3))
    at: dict[int, list[int]] = {}
    for k, (i, j) in enumerate(ends):
        at.setdefault(i + j, []).append(k)
    for k in at.get(0, []):
        last[k, 0] = 0
    for d in range(1, n + m + 1):
        lo, hi = max(0, d - m), min(n, d)
        for z in (M, X, Y):
            z[:, max(0, lo - 1) : hi + 2] = NEG
        x0, y1 = max(lo, 1), min(hi, d - 1) + 1
        c = code[d]
        if x0 <= hi:
            here, up = slice(x0, hi + 1), slice(x0 - 1, hi)
            v, e = vo[:, d - hi : d - x0 + 1][:, ::-1], ve[:, d - hi : d - x0 + 1][:, ::-1]
            opened = np.maximum(M1[:, up], Y1[:, up]) - v - e
            go = X1[:, up] - e
            on = go > opened
            X[:, here] = np.where(on, go, opened)
            c[:, here] |= np.where(on, np.uint8(12), (Y1[:, up] > M1[:, up]).astype(np.uint8) << 3)
        if lo < y1:
            here = slice(lo, y1)
            opened = np.maximum(M1[:, here], X1[:, here]) - ho[:, here] - he[:, here]
            go = Y1[:, here] - he[:, here]
            on = go > opened
            Y[:, here] = np.where(on, go, opened)
            c[:, here] |= np.where(on, np.uint8(48), (X1[:, here] > M1[:, here]).astype(np.uint8) << 4)
        if x0 < y1:
            here, up = slice(x0, y1), slice(x0 - 1, y1 - 1)
            best, lane = M2[:, up], np.zeros((B, y1 - x0), np.uint8)
            for k, lane_before in ((1, X2), (2, Y2)):
                better = lane_before[:, up] > best
                best = np.where(better, lane_before[:, up], best)
                lane[better] = k
            if local:
                fresh = best <= 0
                best = np.where(fresh, np.float32(0), best)
                lane[fresh] = 3
            first = x0 * (m - 1) - m + d - 1
            s = flat[:, first : first + (y1 - x0 - 1) * (m - 1) + 1 : max(m - 1, 1)] if y1 - x0 > 1 else flat[:, first : first + 1]
            M[:, here] = best + s
            c[:, here] |= lane
            if local:
                k = np.argmax(M[:, here], axis=1)
                v = M[np.arange(B), x0 + k]
                i = x0 + k
                new = (v > top[:, 0]) | ((v == top[:, 0]) & (v > 0) & (i < top[:, 1]))
                top[new] = np.column_stack([v, i, d - i])[new]
        if local:
            if lo == 0:
                M[:, 0] = 0
            if hi == d:
                M[:, d] = 0
        for k in at.get(d, []):
            last[k] = M[k, ends[k][0]], X[k, ends[k][0]], Y[k, ends[k][0]]
        M, X, Y, M1, X1, Y1, M2, X2, Y2 = M2, X2, Y2, M, X, Y, M1, X1, Y1
    return code, top if local else last


def trace(i: int, j: int, lane: int, code: np.ndarray, local: bool = False) -> list[int]:
    """Steps from the start: 0 a pair, 1 a residue of a alone, 2 one of b. code: [diagonal, row]."""
    ops = []
    while i > 0 or j > 0:
        c = int(code[i + j, i])
        if lane == 0:
            if i == 0 or j == 0:
                ops += [1] * i + [2] * j
                break
            ops.append(0)
            i, j, nxt = i - 1, j - 1, c & 3
            if local and nxt == 3:
                break
            lane = nxt
        elif lane == 1:
            ops.append(1)
            i, nxt = i - 1, c >> 2 & 3
            lane = 1 if nxt == 3 else nxt
        else:
            ops.append(2)
            j, nxt = j - 1, c >> 4 & 3
            lane = 2 if nxt == 3 else nxt
    return ops[::-1]


def path(S: np.ndarray, vo: np.ndarray, ve: np.ndarray, ho: np.ndarray, he: np.ndarray) -> list[int]:
    """The best global path of one problem."""
    n, m = S.shape
    code, last = fill(np.ascontiguousarray(S, np.float32)[None], vo[None], ve[None], ho[None], he[None], [(n, m)])
    return trace(n, m, int(np.argmax(last[0])), code[:, 0])


def _penalties(n: int, m: int, open: float, extend: float, terminal: float):
    vo, ve = np.full(m + 1, open, np.float32), np.full(m + 1, extend, np.float32)
    ho, he = np.full(n + 1, open, np.float32), np.full(n + 1, extend, np.float32)
    for arr in (vo, ve, ho, he):
        arr[0] *= np.float32(terminal)
        if len(arr) > 1:
            arr[-1] *= np.float32(terminal)
    return vo, ve, ho, he


def rows_of(a: str, b: str, ops: list[int]) -> tuple[str, str]:
    ra, rb, i, j = [], [], 0, 0
    for o in ops:
        ra.append(a[i] if o != 2 else "-")
        rb.append(b[j] if o != 1 else "-")
        i += o != 2
        j += o != 1
    return "".join(ra), "".join(rb)


def score_ops(ops: list[int], S: np.ndarray, pen) -> float:
    """The score of a path; a gap of length L costs open + L * extend."""
    vo, ve, ho, he = pen
    total, i, j, last = np.float32(0), 0, 0, 0
    for o in ops:
        if o == 0:
            total += S[i, j]
            i, j = i + 1, j + 1
        elif o == 1:
            total -= ve[j] + (vo[j] if last != 1 else np.float32(0))
            i += 1
        else:
            total -= he[i] + (ho[i] if last != 2 else np.float32(0))
            j += 1
        last = o
    return float(total)


def _batch(pairs: list[tuple[str, str]], table: np.ndarray, open: float, extend: float, terminal: float):
    """Scores and penalties of pairs, padded to the longest."""
    n, m = (max(len(p[k]) for p in pairs) for k in (0, 1))
    S = np.zeros((len(pairs), n, m), np.float32)
    pens = [np.zeros((len(pairs), size), np.float32) for size in (m + 1, m + 1, n + 1, n + 1)]
    for k, (a, b) in enumerate(pairs):
        S[k, : len(a), : len(b)] = table[_codes(a)[:, None], _codes(b)[None, :]]
        for p, own in zip(pens, _penalties(len(a), len(b), open, extend, terminal), strict=True):
            p[k, : len(own)] = own
    return S, pens


#: Cells of all problems that are worked on at once.
BATCH_CELLS = 4_000_000


def batches(lengths: list[tuple[int, int]]):
    """Numbers of pairs that go together: of like length, and within BATCH_CELLS; those with an empty side are left out."""
    order = sorted((k for k, (a, b) in enumerate(lengths) if a and b), key=lambda k: lengths[k])
    while order:
        take, n, m = 0, 0, 0
        while take < len(order):
            a, b = lengths[order[take]]
            n, m = max(n, a), max(m, b)
            if take and (take + 1) * (n + m) * (n + 1) > BATCH_CELLS:
                break
            take += 1
        yield order[:take]
        order = order[take:]


def global_pairs(pairs: list[tuple[str, str]], table: np.ndarray, open: float, extend: float, terminal: float = 1.0) -> list[tuple[str, str, float]]:
    """Both rows and the score of each pair. terminal: the factor on gaps at either end (0: free ends)."""
    ops: list[list[int]] = [[1] * len(a) + [2] * len(b) for a, b in pairs]
    for own in batches([(len(a), len(b)) for a, b in pairs]):
        some = [pairs[k] for k in own]
        S, pens = _batch(some, table, open, extend, terminal)
        code, last = fill(S, *pens, [(len(a), len(b)) for a, b in some])
        for x, k in enumerate(own):
            ops[k] = trace(len(pairs[k][0]), len(pairs[k][1]), int(np.argmax(last[x])), code[:, x])
    out = []
    for (a, b), o in zip(pairs, ops, strict=True):
        S = table[_codes(a)[:, None], _codes(b)[None, :]]
        out.append((*rows_of(a, b, o), score_ops(o, S, _penalties(len(a), len(b), open, extend, terminal))))
    return out


def local_pairs(pairs: list[tuple[str, str]], table: np.ndarray, open: float, extend: float) -> list[tuple[str, str, float, int, int, int, int]]:
    """Rows, score, and the ranges of both sequences; nothing and 0 where no pair scores above 0."""
    out = [("", "", 0.0, 0, 0, 0, 0)] * len(pairs)
    for own in batches([(len(a), len(b)) for a, b in pairs]):
        some = [pairs[k] for k in own]
        S, pens = _batch(some, table, open, extend, 1.0)
        for x, (a, b) in enumerate(some):  # nothing is gained beyond a sequence's end
            S[x, len(a) :, :] = S[x, :, len(b) :] = NEG
        code, top = fill(S, *pens, [(0, 0)] * len(some), local=True)
        for x, k in enumerate(own):
            score, i, j = float(top[x, 0]), int(top[x, 1]), int(top[x, 2])
            if score > 0:
                a, b = pairs[k]
                o = trace(i, j, 0, code[:, x], local=True)
                i0, j0 = i - sum(v != 2 for v in o), j - sum(v != 1 for v in o)
                out[k] = (*rows_of(a[i0:i], b[j0:j], o), score, i0, i, j0, j)
    return out


def global_align(a: str, b: str, table: np.ndarray, open: float, extend: float, terminal: float = 1.0) -> tuple[str, str, float]:
    return global_pairs([(a, b)], table, open, extend, terminal)[0]


def local_align(a: str, b: str, table: np.ndarray, open: float, extend: float) -> tuple[str, str, float, int, int, int, int]:
    return local_pairs([(a, b)], table, open, extend)[0]
