"""Progressive multiple alignment of one set of sequences, with optional refinement."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from strandline.alphabet import GAPS, GROUPS, KMER, PROTEIN
from strandline.errors import AlgorithmError
from strandline.kernels import matrices, trees
from strandline.kernels.pairwise import batches, fill, global_pairs, path, trace

_REFERENCE = 5.8  # mean diagonal of BLOSUM62; penalties are scaled to a table by it
#: Cells of pairwise alignments up to which the clustal engine's tree comes from them; above, from k-mers.
PAIRWISE_CELLS = 200_000_000


@dataclass(frozen=True)
class Params:
    engine: str = "clustal"
    open: float = 5.0
    extend: float = 1.0
    terminal: float = 0.5
    matrix: str = "auto"
    iterations: int = 0
    #: A table read from a file (matrices.from_ncbi, matrices.read), in place of a named one.
    table: matrices.Matrix | None = None
    #: kmer, pairwise, or auto: pairwise for clustal up to PAIRWISE_CELLS, else kmer.
    distance: str = "auto"
    #: nj, upgma, or auto: nj for clustal up to trees.MOST_JOINED rows, else upgma.
    tree: str = "auto"

    def __post_init__(self) -> None:
        for what, of in (("distance", ("auto", "kmer", "pairwise")), ("tree", ("auto", "nj", "upgma"))):
            if getattr(self, what) not in of:
                raise AlgorithmError(f"{what} must be one of {', '.join(of)}")

    def scores(self, alphabet: str) -> matrices.Matrix:
        return self.table or matrices.choose(alphabet, self.matrix)

    @classmethod
    def of(cls, engine: str) -> Params:
        return cls(engine, iterations={"clustal": 0, "muscle": 2, "mafft": 2}[engine])


def kmer_distances(seqs: list[str], alphabet: str) -> np.ndarray:
    """1 - shared k-mers / k-mers of the shorter one; 1 where one has none."""
    k = KMER[alphabet]
    code = np.full(128, -1, np.int64)
    for g, letters in enumerate(GROUPS if alphabet == PROTEIN else ("A", "C", "G", "TU")):
        for c in letters + letters.lower():
            code[ord(c)] = g
    base = len(GROUPS) if alphabet == PROTEIN else 4
    found = []
    for s in seqs:
        c = code[np.frombuffer(s.encode("ascii", "replace"), np.uint8) & 127]
        if len(c) < k:
            found.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        w = np.lib.stride_tricks.sliding_window_view(c, k)
        w = w[(w >= 0).all(1)]
        found.append(np.unique(w @ (base ** np.arange(k)), return_counts=True))
    n = len(seqs)
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i):
            least = min(found[i][1].sum(), found[j][1].sum())
            _, x, y = np.intersect1d(found[i][0], found[j][0], assume_unique=True, return_indices=True)
            out[i, j] = out[j, i] = 1.0 if least == 0 else 1 - np.minimum(found[i][1][x], found[j][1][y]).sum() / least
    return out


def corrected(p: np.ndarray, alphabet: str) -> np.ndarray:
    """Shares of differing residues as distances: Jukes-Cantor for nucleotides, Kimura's formula for proteins; 5 at most."""
    knee = 0.75
    q = np.minimum(p, knee)
    if alphabet != PROTEIN:
        return np.where(p < knee, -0.75 * np.log(1 - 4 * np.where(p < knee, p, 0) / 3), 5.0)
    return -np.log(1 - q - 0.2 * q * q) + (p - q) / (1 - knee) * (5.0 + np.log(1 - knee - 0.2 * knee**2))


def pairwise_distances(seqs: list[str], alphabet: str) -> np.ndarray:
    """Corrected distances after global alignment of each pair by the alphabet's own table, whatever the engine's penalties."""
    m = matrices.choose(alphabet)
    scale = m.mean_diagonal / _REFERENCE
    n = len(seqs)
    i, j = np.tril_indices(n, -1)
    share = np.zeros(len(i))
    for k in range(0, len(i), 64):  # as many pairs have their rows at once
        for x, (a, b, _) in enumerate(global_pairs([(seqs[p], seqs[q]) for p, q in zip(i[k : k + 64], j[k : k + 64], strict=True)], m.table, 10.0 * scale, 0.5 * scale), k):
            a, b = (np.frombuffer(r.upper().encode("ascii", "replace"), np.uint8) for r in (a, b))
            both = (a != ord("-")) & (b != ord("-"))
            share[x] = (both & (a != b)).sum() / max(1, both.sum())
    return trees.square(n, i, j, corrected(share, alphabet))


def guide_distances(seqs: list[str], alphabet: str, engine: str, distance: str = "auto") -> np.ndarray:
    """By default for clustal of pairwise alignments, if these have PAIRWISE_CELLS at most; else of k-mers."""
    n = len(seqs)
    cells = n * (n - 1) // 2 * (sum(map(len, seqs)) // n) ** 2
    aligned = distance == "pairwise" or distance == "auto" and engine == "clustal" and cells <= PAIRWISE_CELLS
    return pairwise_distances(seqs, alphabet) if aligned else kmer_distances(seqs, alphabet)


def guide_tree(d: np.ndarray, p: Params) -> trees.Tree:
    if p.tree == "nj":
        return trees.neighbor_joining(d)
    return trees.build(d, "nj" if p.tree == "auto" and p.engine == "clustal" else "upgma")


def henikoff(rows: list[np.ndarray]) -> np.ndarray:
    """Position-based weights of aligned rows, a gap being a kind of its own; columns in which all agree don't count. Mean 1, at least 1e-4."""
    x, w = np.stack(rows), np.zeros(len(rows))
    for column in x.T:
        kinds, back, n = np.unique(column, return_inverse=True, return_counts=True)
        if len(kinds) > 1:
            w += 1.0 / (len(kinds) * n[back])
    return np.maximum(w / w.mean(), 1e-4) if w.any() else np.ones(len(rows))


class Profile:
    """Gapped rows with weights, and the weighted letters of each column."""

    def __init__(self, rows: list[np.ndarray], ids: list[int], w: np.ndarray):
        self.rows, self.ids, self.w = rows, ids, w
        m = np.stack(rows) if rows else np.zeros((0, 0), np.uint8)
        self.width = m.shape[1]
        self.freq = np.zeros((self.width, 128), np.float32)
        for r, x in zip(m, w, strict=True):
            self.freq[np.arange(self.width), r] += np.float32(x)
        self.gap = self.freq[:, ord("-")].copy()
        self.freq[:, ord("-")] = 0
        self.total = np.float32(w.sum())


def _gap_scale(p: Profile) -> tuple[np.ndarray, np.ndarray]:
    """Factors on opening and extending a gap before each column: cheap where there are gaps, dear close by."""
    share = p.gap / p.total
    has = p.gap > 0
    open_, ext = np.ones(p.width, np.float32), np.ones(p.width, np.float32)
    at = np.flatnonzero(has)
    if len(at):
        col = np.arange(p.width)
        k = np.searchsorted(at, col)
        near = np.minimum(np.abs(col - at[np.minimum(k, len(at) - 1)]), np.abs(col - at[np.maximum(k - 1, 0)]))
        close = ~has & (near <= 8)
        open_[close] = 2 + (8 - near[close]) * 2 / 8
        open_[has] = 0.3 * (1 - share[has])
        ext[has] = 0.5
    return open_, ext


def _problem(a: Profile, b: Profile, m: matrices.Matrix, p: Params) -> tuple[np.ndarray, ...]:
    """Scores of columns against columns, and the penalties by column and by row."""
    scale = m.mean_diagonal / _REFERENCE
    letters = np.flatnonzero((a.freq.sum(0) > 0) | (b.freq.sum(0) > 0))
    S = (a.freq[:, letters] @ m.table[np.ix_(letters, letters)] @ b.freq[:, letters].T) / (a.total * b.total)

    def arrays(q: Profile) -> tuple[np.ndarray, np.ndarray]:
        o, e = _gap_scale(q)
        o, e = (np.append(x, x[-1]) * np.float32(y * scale) for x, y in ((o, p.open), (e, p.extend)))
        for x in (o, e):
            x[0] *= np.float32(p.terminal)
            x[-1] *= np.float32(p.terminal)
        return o, e

    vo, ve = arrays(b)
    ho, he = arrays(a)
    return S, vo, ve, ho, he


def align_profiles(a: Profile, b: Profile, m: matrices.Matrix, p: Params) -> list[int]:
    if not a.width or not b.width:
        return [1] * a.width + [2] * b.width
    return path(*_problem(a, b, m, p))


def align_profile_pairs(pairs: list[tuple[Profile, Profile]], m: matrices.Matrix, p: Params) -> list[list[int]]:
    """align_profiles of each pair; those of like width are filled together."""
    ops = [[1] * a.width + [2] * b.width for a, b in pairs]
    for own in batches([(a.width, b.width) for a, b in pairs]):
        w, v = (max(pairs[k][side].width for k in own) for side in (0, 1))
        S, *pens = (np.zeros((len(own), *size), np.float32) for size in ((w, v), (v + 1,), (v + 1,), (w + 1,), (w + 1,)))
        for x, k in enumerate(own):
            s, *some = _problem(*pairs[k], m, p)
            S[x, : s.shape[0], : s.shape[1]] = s
            for pen, one in zip(pens, some, strict=True):
                pen[x, : len(one)] = one
        ends = [(pairs[k][0].width, pairs[k][1].width) for k in own]
        code, last = fill(S, *pens, ends)
        for x, k in enumerate(own):
            ops[k] = trace(*ends[x], int(np.argmax(last[x])), code[:, x])
    return ops


def merge(a: Profile, b: Profile, ops: list[int]) -> Profile:
    o = np.array(ops)
    gap = np.uint8(ord("-"))
    rows = []
    for p, skip in ((a, 2), (b, 1)):
        for r in p.rows:
            new = np.full(len(o), gap)
            new[o != skip] = r
            rows.append(new)
    return Profile(rows, a.ids + b.ids, np.append(a.w, b.w))


def progressive(seqs: list[np.ndarray], tree: trees.Tree, w: np.ndarray, m: matrices.Matrix, p: Params) -> list[np.ndarray]:
    nodes: list[Profile | None] = [Profile([s], [i], w[i : i + 1]) for i, s in enumerate(seqs)]
    for a, b, _, _ in tree:
        x, y = nodes[a], nodes[b]
        nodes.append(merge(x, y, align_profiles(x, y, m, p)))
        nodes[a] = nodes[b] = None
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(seqs)
    for i, r in zip(nodes[-1].ids, nodes[-1].rows, strict=True):
        out[i] = r
    return out


def sp_score(rows: list[np.ndarray], w: np.ndarray, m: matrices.Matrix, p: Params) -> float:
    """Weighted sum over pairs of rows, in closed form by column, with affine gaps (less at the ends)."""
    x = np.stack(rows)
    scale = m.mean_diagonal / _REFERENCE
    gap = x == ord("-")
    width = x.shape[1]
    k = np.unique(x[~gap])
    f = np.stack([w @ (x == c) for c in k], axis=1) if len(k) else np.zeros((width, 0))
    own = ((w[:, None] ** 2) * np.where(gap, 0, m.table[x & 127, x & 127])).sum()
    pairs = 0.5 * (((f @ m.table[np.ix_(k, k)]) * f).sum() - own)
    before = np.concatenate([gap[:, :1], gap[:, :-1]], axis=1)
    filled = np.cumsum(~gap, axis=1)
    outer = (filled == 0) | ((filled == filled[:, -1:]) & gap)
    kind = before * 1 + gap * 2 + outer * 4
    cost = 0.0
    cls = [w @ (kind == u) for u in range(8)]
    for u in range(8):
        for v in range(u + 1, 8):
            if (u & 2) != (v & 2):
                g = u if u & 2 else v
                other = v if u & 2 else u
                factor = p.terminal if g & 4 else 1.0
                goes_on = (g & 1) and not (other & 1)
                cost += (cls[u] @ cls[v]) * factor * scale * (p.extend + (0 if goes_on else p.open))
    return float(pairs - cost)


def _squeeze(rows: list[np.ndarray]) -> list[np.ndarray]:
    if not rows:
        return rows
    keep = (np.stack(rows) != ord("-")).any(0)
    return [r[keep] for r in rows]


def _refine(rows: list[np.ndarray], tree: trees.Tree, w: np.ndarray, m: matrices.Matrix, p: Params) -> list[np.ndarray]:
    """Tree edges from the deepest: both sides are realigned, and kept where the score rises."""
    n = len(rows)
    below, depth = trees.leaves_below(tree, n), trees.depths(tree, n)
    edges = sorted((c for t in tree for c in t[:2]), key=lambda c: -depth[c])
    best = sp_score(rows, w, m, p)
    for _ in range(p.iterations):
        changed = False
        for c in edges:
            inside = below[c]
            rest = [i for i in range(n) if i not in set(inside)]
            if not rest:
                continue
            a, b = (Profile(_squeeze([rows[i] for i in s]), s, w[s]) for s in (inside, rest))
            merged = merge(a, b, align_profiles(a, b, m, p))
            new: list[np.ndarray] = [np.zeros(0, np.uint8)] * n
            for i, r in zip(merged.ids, merged.rows, strict=True):
                new[i] = r
            score = sp_score(new, w, m, p)
            if score > best + 1e-4:
                rows, best, changed = new, score, True
        if not changed:
            break
    return rows


def align(residues: list[str], alphabet: str, p: Params = Params()) -> list[str]:
    """Aligned rows of equal length in the given order; gaps in the input don't count."""
    plain = ["".join(c for c in s if c not in GAPS) for s in residues]
    full = [i for i, s in enumerate(plain) if s]
    if len(full) < 2:
        width = max(map(len, plain), default=0)
        return [s.ljust(width, "-") for s in plain]
    seqs = [np.frombuffer(plain[i].encode("ascii", "replace"), np.uint8) for i in full]
    m = p.scores(alphabet)
    tree = guide_tree(guide_distances([plain[i] for i in full], alphabet, p.engine, p.distance), p)
    w = trees.weights(tree, len(full))
    rows = progressive(seqs, tree, w, m, p)
    if p.engine == "mafft":
        best = sp_score(rows, w, m, p)
        for _ in range(1 + min(max(p.iterations, 1), 4) - 1):
            t2 = trees.upgma(_identity_distances(rows))
            w2 = trees.weights(t2, len(full))
            new = progressive(seqs, t2, w2, m, p)
            score = sp_score(new, w, m, p)
            if score <= best + 1e-4:
                break
            rows, best = new, score
    elif p.engine == "muscle":
        tree = trees.upgma(_identity_distances(rows))
        w = trees.weights(tree, len(full))
        rows = _refine(progressive(seqs, tree, w, m, p), tree, w, m, p)
    rows = _squeeze(rows)
    out = ["-" * len(rows[0])] * len(residues)
    for i, r in zip(full, rows, strict=True):
        out[i] = r.tobytes().decode()
    return out


def _identity_distances(rows: list[np.ndarray]) -> np.ndarray:
    x = np.stack(rows)
    n = len(x)
    out = np.zeros((n, n))
    for i in range(n):
        both = (x != ord("-")) & (x[i] != ord("-"))
        differ = (both & (x != x[i])).sum(1)
        out[i] = np.where(both.sum(1) > 0, differ / np.maximum(both.sum(1), 1), 0)
    return out


def realign_columns(rows: list[str], start: int, end: int, alphabet: str, p: Params = Params()) -> list[str]:
    """Only the columns start to end (clipped) are aligned anew."""
    width = max(map(len, rows), default=0)
    rows = [r.ljust(width, "-") for r in rows]
    start, end = max(0, min(start, width)), max(0, min(end, width))
    middle = align([r[start:end] for r in rows], alphabet, p)
    return [r[:start] + x + r[end:] for r, x in zip(rows, middle, strict=True)]


def add_to(base: list[str], queries: list[str], alphabet: str, p: Params = Params()) -> list[str]:
    """Queries are aligned among themselves and then, as a profile, to the base, whose rows only get gaps; shorter rows of the
    base are padded first. Both profiles have position-based weights."""
    m, width = p.scores(alphabet), max(map(len, base), default=0)
    enc = lambda rows: [np.frombuffer(r.encode("ascii", "replace"), np.uint8) for r in rows]
    old, new = enc(r.ljust(width, "-") for r in base), enc(align(queries, alphabet, p))
    up = lambda rows: henikoff([np.frombuffer(r.tobytes().upper(), np.uint8) for r in rows])
    a, b = Profile(old, list(range(len(old))), up(old)), Profile(new, list(range(len(old), len(old) + len(new))), up(new))
    return [r.tobytes().decode() for r in merge(a, b, align_profiles(a, b, m, p)).rows]
