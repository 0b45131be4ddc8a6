"""Substitution scores as 128 x 128 arrays over ASCII codes, letters in either case."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from strandline.alphabet import PROTEIN

#: BLOSUM62 as published, lower triangle in the order of its letters, with those for several residues.
_ORDER = "ARNDCQEGHILKMFPSTWYV"
_PUBLISHED = _ORDER + "BZX"
_BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
-2 -1 3 4 -3 0 1 -1 0 -3 -4 0 -3 -3 -2 0 -1 -4 -3 -3 4
-1 0 0 1 -3 3 4 -2 0 -3 -3 1 -1 -3 -1 0 -1 -3 -2 -2 1 4
0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2 0 0 -2 -1 -1 -1 -1 -1
"""
#: Nucleotides under each IUPAC letter.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT", "X": "ACGT"}
#: Scores of A, C, G, T with each other in the alternative nucleotide table.
_CLUSTAL_DNA = ((0.91, -1.14, -0.31, -1.23), (-1.14, 1.0, -1.25, -0.31), (-0.31, -1.25, 1.0, -1.14), (-1.23, -0.31, -1.14, 0.91))


@dataclass(frozen=True)
class Matrix:
    name: str
    table: np.ndarray
    mean_diagonal: float


def _finish(name: str, scores: dict[tuple[str, str], float], letters: str, fill: float) -> Matrix:
    t = np.full((128, 128), fill, np.float32)
    for (a, b), v in scores.items():
        for x in {a, a.lower()}:
            for y in {b, b.lower()}:
                t[ord(x), ord(y)] = t[ord(y), ord(x)] = v
    for g in "-.~":
        t[ord(g), :] = t[:, ord(g)] = 0
    return Matrix(name, t, float(np.mean([scores[a, a] for a in letters])))


def from_ncbi(name: str, text: str) -> Matrix:
    """A protein table in the layout that NCBI publishes (BLOSUM, PAM): a header line of letters, a row each."""
    rows = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
    cols = rows[0].split()
    scores = {(r.split()[0], c): float(v) for r in rows[1:] for c, v in zip(cols, r.split()[1:], strict=True)}
    return _protein(name, scores)


def read(spark, path: str) -> Matrix:
    """A published protein table from a file on any store that Spark reads, for Params(table=...)."""
    lines = [r["value"] for r in spark.read.text(path, wholetext=True).limit(1).collect()]  # a table of some 25 rows
    return from_ncbi(path.rstrip("/").rpartition("/")[2], lines[0] if lines else "")


def _protein(name: str, scores: dict[tuple[str, str], float]) -> Matrix:
    core = _ORDER
    s = dict(scores)
    get = lambda a, b: s.get((a, b), s.get((b, a)))
    for amb, parts in (("B", "DN"), ("Z", "EQ"), ("X", core)):  # means over what they stand for, where the table has none
        if get(amb, "A") is None:
            for c in core:
                s[amb, c] = float(np.floor(np.mean([get(p, c) for p in parts]) + 0.5)) if amb != "X" else -1.0
    for a, b in (("B", "B"), ("Z", "Z"), ("B", "Z"), ("X", "X"), ("X", "B"), ("X", "Z")):
        if get(a, b) is None:
            s[a, b] = {"BB": 4.0, "ZZ": 4.0, "BZ": 1.0}.get(a + b, -1.0)
    for alias, of in (("J", "X"), ("?", "X"), ("U", "C"), ("O", "K")):
        for c in [*core, "B", "Z", "X"]:
            s[alias, c] = get(of, c)
    for a, of_a in (("J", "X"), ("?", "X"), ("U", "C"), ("O", "K")):
        for b, of_b in (("J", "X"), ("?", "X"), ("U", "C"), ("O", "K")):
            s[a, b] = get(of_a, of_b)
    return _finish(name, {k: v for k, v in s.items() if "*" not in k}, core, get("X", "X"))


def blosum62() -> Matrix:
    rows = [x.split() for x in _BLOSUM62.strip().splitlines()]
    return _protein("BLOSUM62", {(_PUBLISHED[i], _PUBLISHED[j]): float(v) for i, r in enumerate(rows) for j, v in enumerate(r)})


def iub() -> Matrix:
    """1.9 where two letters can mean one base (N, X and ? with anything), else 0."""
    letters = {**IUPAC, "?": "ACGT"}
    return _finish("IUB", {(a, b): 1.9 if set(x) & set(y) else 0.0 for a, x in letters.items() for b, y in letters.items()}, "ACGT", 0.0)


def clustal_dna() -> Matrix:
    """Means over the bases that letters stand for."""
    s = {(a, b): float(np.mean([_CLUSTAL_DNA["ACGT".index(x)]["ACGT".index(y)] for x in xs for y in ys])) for a, xs in IUPAC.items() for b, ys in IUPAC.items()}
    return _finish("ClustalW DNA", s, "ACGT", 0.0)


def identity() -> Matrix:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    s = {(a, b): 1.0 if a == b or {a, b} == {"T", "U"} else 0.0 for a in letters for b in letters}
    return _finish("identity", s, letters, 0.0)


def choose(alphabet: str, name: str = "auto") -> Matrix:
    if name == "auto":
        return blosum62() if alphabet == PROTEIN else iub()
    return {"blosum62": blosum62, "iub": iub, "clustal_dna": clustal_dna, "identity": identity}[name]()
