"""Alignment kernels against enumeration of all alignments, trees against worked examples, invariants of sets."""

from functools import lru_cache

import numpy as np
import pytest

from strandline.kernels import matrices, msa, pairwise, trees


def best_score(a, b, table, open_, ext, terminal):
    n, m = len(a), len(b)

    @lru_cache(None)
    def go(i, j, last):
        if i == n and j == m:
            return 0.0
        out = -1e9
        if i < n and j < m:
            out = max(out, table[ord(a[i]), ord(b[j])] + go(i + 1, j + 1, 0))
        if i < n:
            f = terminal if j in (0, m) else 1
            out = max(out, go(i + 1, j, 1) - f * (ext + (open_ if last != 1 else 0)))
        if j < m:
            f = terminal if i in (0, n) else 1
            out = max(out, go(i, j + 1, 2) - f * (ext + (open_ if last != 2 else 0)))
        return out

    return go(0, 0, 0)


@pytest.mark.parametrize("terminal", [0.0, 0.5, 1.0])
def test_global(terminal):
    rng = np.random.default_rng(1)
    t = matrices.blosum62().table
    for _ in range(60):
        a, b = ("".join(rng.choice(list("ACDW"), rng.integers(0, 7))) for _ in range(2))
        ra, rb, s = pairwise.global_align(a, b, t, 3.0, 1.0, terminal)
        assert ra.replace("-", "") == a and rb.replace("-", "") == b and len(ra) == len(rb)
        assert abs(s - best_score(a, b, t, 3.0, 1.0, terminal)) < 1e-3


def test_local():
    rng = np.random.default_rng(2)
    t = matrices.iub().table - 0.9
    for _ in range(40):
        a, b = ("".join(rng.choice(list("ACGT"), rng.integers(0, 7))) for _ in range(2))
        ra, rb, s, a0, a1, b0, b1 = pairwise.local_align(a, b, t, 2.0, 0.5)
        best = max([best_score(a[i:j], b[k:m], t, 2.0, 0.5, 1.0) for i in range(len(a)) for j in range(i + 1, len(a) + 1) for k in range(len(b)) for m in range(k + 1, len(b) + 1)], default=0)
        assert abs(s - max(best, 0)) < 1e-3
        assert ra.replace("-", "") == a[a0:a1] and rb.replace("-", "") == b[b0:b1]


def test_matrices():
    m = matrices.blosum62()
    assert m.mean_diagonal == 5.8 and m.table[ord("w"), ord("W")] == 11 and m.table[ord("U"), ord("C")] == 9 and m.table[ord("-"), ord("A")] == 0
    assert np.array_equal(m.table, m.table.T)
    i = matrices.iub()
    assert abs(i.mean_diagonal - 1.9) < 1e-6 and i.table[ord("N"), ord("G")] == np.float32(1.9) and i.table[ord("A"), ord("Y")] == 0 and i.table[ord("T"), ord("U")] == np.float32(1.9)
    assert matrices.identity().table[ord("t"), ord("U")] == 1
    text = "   A  R\nA  4 -1\nR -1  5\n"
    with pytest.raises(TypeError):
        matrices.from_ncbi("part", text)  # letters are missing


def test_neighbor_joining_recovers_an_additive_tree():
    d = np.array([[0, 5, 9, 9, 8], [5, 0, 10, 10, 9], [9, 10, 0, 8, 7], [9, 10, 8, 0, 3], [8, 9, 7, 3, 0]], float)
    t = trees.neighbor_joining(d)
    n = 5
    up = {}
    for k, (a, b, la, lb) in enumerate(t):
        up[a], up[b] = (n + k, la), (n + k, lb)

    def path(x):
        out, total = {x: 0.0}, 0.0
        while x in up:
            x, length = up[x]
            total += length
            out[x] = total
        return out

    for i in range(n):
        for j in range(i):
            p, q = path(i), path(j)
            assert abs(min(p[x] + q[x] for x in p if x in q) - d[i, j]) < 1e-9


def test_upgma_and_newick():
    d = np.array([[0, 2, 6], [2, 0, 6], [6, 6, 0]], float)
    t = trees.upgma(d)
    assert sorted(t[0][:2]) == [0, 1] and t[0][2:] == (1.0, 1.0)
    assert sorted(t[1][2:]) == [2.0, 3.0]
    assert trees.newick(t, ["a b", "", "c"]).count("(") == 2 and "a_b:1.00000" in trees.newick(t, ["a b", "", "c"]) and "seq1" in trees.newick(t, ["a b", "", "c"])
    assert trees.depths(t, 3)[2] == 1 and abs(trees.weights(t, 3).mean() - 1) < 1e-9


def evolve(rng, n, length):
    """Rows with a known true alignment: substitutions and deletions from one ancestor."""
    root = rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), length)
    rows = []
    for _ in range(n):
        r = root.copy()
        sub = rng.random(length) < 0.06
        r[sub] = rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), sub.sum())
        r[rng.random(length) < 0.02] = "-"
        rows.append("".join(r))
    return rows


@pytest.mark.parametrize("engine", ["clustal", "muscle", "mafft"])
def test_alignment_of_related_rows(engine):
    truth = evolve(np.random.default_rng(5), 8, 80)
    plain = [r.replace("-", "") for r in truth]
    got = msa.align(plain, "protein", msa.Params.of(engine))
    assert [r.replace("-", "") for r in got] == plain and len({len(r) for r in got}) == 1

    def pairs(rows):
        out = set()
        pos = [np.cumsum([c != "-" for c in r]) for r in rows]
        for c in range(len(rows[0])):
            here = [(i, pos[i][c]) for i in range(len(rows)) if rows[i][c] != "-"]
            out |= {(x, y) for x in here for y in here if x < y}
        return out

    want = pairs(truth)
    assert len(want & pairs(got)) / len(want) > 0.9


def diverged(seed):
    rng = np.random.default_rng(seed)
    root = rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), 60)
    rows = []
    for k in range(6):
        r = root.copy()
        sub = rng.random(60) < 0.15 * (k + 1)
        r[sub] = rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), sub.sum())
        rows.append("".join(r[rng.random(60) > 0.05]))
    return rows


def test_clustal_tree_comes_from_pairwise_alignments(monkeypatch):
    rows = diverged(3)
    d, k = msa.pairwise_distances(rows, "protein"), msa.kmer_distances(rows, "protein")
    m = matrices.choose("protein")
    for i in range(6):
        for j in range(i):
            a, b, _ = pairwise.global_align(rows[i], rows[j], m.table, 10.0 * m.mean_diagonal / 5.8, 0.5 * m.mean_diagonal / 5.8)
            both = [(x, y) for x, y in zip(a, b, strict=True) if "-" not in (x, y)]
            p = sum(x != y for x, y in both) / len(both)
            assert d[i, j] == d[j, i] == pytest.approx(-np.log(1 - p - 0.2 * p * p) if p < 0.75 else 1.984131 + (p - 0.75) * 4 * (5 - 1.984131), abs=1e-4)
    shape = lambda x: sorted(map(sorted, trees.leaves_below(trees.build(x, "nj"), 6)))
    assert shape(d) != shape(k)
    seen = []
    monkeypatch.setattr(msa.trees, "build", lambda x, how, build=trees.build: seen.append(x) or build(x, how))
    msa.align(rows, "protein")
    monkeypatch.setattr(msa, "PAIRWISE_CELLS", 15 * 40 * 40)
    msa.align(rows, "protein")
    msa.align(rows, "protein", msa.Params.of("mafft"))
    assert np.array_equal(seen[0], d) and np.array_equal(seen[1], k) and np.array_equal(seen[2], k)


def test_corrections_at_their_bounds():
    p = np.array([0, 0.3, 0.75, 1.0])
    assert msa.corrected(p, "DNA") == pytest.approx([0, 0.383119, 5, 5], abs=1e-5)
    assert msa.corrected(p, "protein") == pytest.approx([0, 0.382726, 1.984131, 5], abs=1e-3)


def test_pairwise_distance_is_that_of_the_kernel(spark):
    from strandline.operators import align

    rows = diverged(3)
    rows[2] = rows[2].lower()
    d = msa.pairwise_distances(rows, "protein")
    seqs = spark.createDataFrame([("x", k, f"t{k}", r) for k, r in enumerate(rows)], "aln_id string, row_idx int, id string, residues string")
    got = align.pairwise_distance(seqs, "protein").collect()
    assert len(got) == 15 and all(r["d"] == pytest.approx(d[r["i"], r["j"]], abs=1e-9) for r in got)


def test_alignment_of_degenerate_sets():
    assert msa.align([], "protein") == []
    assert msa.align(["", "A-C"], "protein") == ["--", "AC"]
    assert msa.align(["AAA", "AAA"], "DNA") == ["AAA", "AAA"]
    assert msa.align(["--", "", "ACG", "ACG"], "DNA") == ["---", "---", "ACG", "ACG"]


def test_region_and_adding():
    rows = ["ACDE--FGHIKL", "ACDEMMFGHIKL", "ACDEM-FGHI-L"]
    new = msa.realign_columns(rows, 3, 8, "protein")
    assert all(x[:3] == y[:3] and x[-4:] == y[-4:] for x, y in zip(rows, new, strict=True))
    both = msa.add_to(rows, ["ACDEFGHIKL", "CDEMMFGHI"], "protein")
    keep = [k for k in range(len(both[0])) if any(r[k] != "-" for r in both[:3])]
    assert ["".join(r[k] for k in keep) for r in both[:3]] == rows


def test_published_scores_of_letters_for_several_residues():
    t = matrices.blosum62().table
    for pair, score in {"XA": 0, "XC": -2, "XW": -2, "XX": -1, "BN": 3, "BD": 4, "BB": 4, "ZQ": 3, "ZE": 4, "BZ": 1, "BL": -4, "JA": 0, "WW": 11, "CC": 9}.items():
        assert t[ord(pair[0]), ord(pair[1])] == t[ord(pair[1]), ord(pair[0])] == score
