"""Rounds of the guide tree and alignment by rounds, against the kernels that do one set at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.kernels import matrices, msa, trees
from strandline.operators import progressive
from strandline.store import Store


def rows_of(tree, n):
    """The sets of rows that a kernel's tree joins, with the height."""
    below, out, height = trees.leaves_below(tree, n), {}, [0.0] * (n + len(tree))
    for k, (a, _, la, _) in enumerate(tree):
        height[n + k] = height[a] + la
        out[frozenset(below[n + k])] = round(height[n + k], 6)
    return out


def rounds_of(merges):
    below, out = {}, {}
    for m in sorted(merges, key=lambda m: m["round"]):
        left, right = (below.get(m[c], frozenset([m[c]])) for c in ("left", "right"))
        below[m["node"]] = left | right
        out[left | right] = round(m["height"], 6)
    return out


def distances(rng, n):
    d = rng.random((n, n))
    d = d + d.T
    np.fill_diagonal(d, 0)
    return d


@pytest.fixture(scope="module")
def sets(spark):
    """Distances of sets of 1, 2, 9 and 24 rows."""
    rng = np.random.default_rng(2)
    d = {str(n): distances(rng, n) for n in (1, 2, 9, 24)}
    rows = spark.createDataFrame([(a, i) for a, x in d.items() for i in range(len(x))], "aln_id string, row_idx int")
    pairs = spark.createDataFrame([(a, i, j, float(x[i, j])) for a, x in d.items() for i in range(len(x)) for j in range(i)], "aln_id string, i int, j int, d double")
    return d, rows, pairs


def test_rounds(spark, sets):
    d, rows, pairs = sets
    tree, weights = progressive.guide_rounds(pairs, rows, Store(spark, "t"))
    merges, got = tree.collect(), weights.collect()
    for a, x in d.items():
        want = trees.upgma(x)
        assert rounds_of([m for m in merges if m["aln_id"] == a]) == rows_of(want, len(x))
        mine = {r["row_idx"]: r["weight"] for r in got if r["aln_id"] == a}
        assert np.allclose([mine[i] for i in range(len(x))], trees.weights(want, len(x)), atol=1e-9)
    assert max(m["round"] for m in merges) < 30  # far fewer than merges


def test_rounds_with_ties(spark):
    """Equal distances: the same tree for any layout, all rows in it."""
    rows = spark.createDataFrame([("a", i) for i in range(12)], "aln_id string, row_idx int")
    pairs = spark.createDataFrame([("a", i, j, float(i // 4 != j // 4)) for i in range(12) for j in range(i)], "aln_id string, i int, j int, d double")
    trees_ = [rounds_of(progressive.guide_rounds(pairs.repartition(p), rows, Store(spark, "t"))[0].collect()) for p in (1, 7)]
    assert trees_[0] == trees_[1] and frozenset(range(12)) in trees_[0] and len(trees_[0]) == 11


def mutated(rng, n, length=40):
    base = [rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(length)]
    out = []
    for _ in range(n):
        s = [c if rng.random() < 0.85 else rng.choice("ACDEFGHIKLMNPQRSTVWY") for c in base]
        at = rng.randrange(length)
        out.append("".join(s[:at] + s[at + rng.randrange(4) :]))
    return out


def test_levels_equal_the_kernel(spark):
    """Given one tree and weights, rows are those of the kernel that holds the whole set."""
    rng = random.Random(4)
    sets = {"a": mutated(rng, 13), "b": mutated(rng, 2), "c": mutated(rng, 16)}
    d = {a: distances(np.random.default_rng(ord(a)), len(s)) for a, s in sets.items()}
    tree, leaf = {a: trees.upgma(x) for a, x in d.items()}, []
    merges = []
    for a, t in tree.items():
        n, level, node = len(sets[a]), [0] * len(sets[a]), list(range(len(sets[a])))
        for x, y, lx, _ in t:
            level.append(1 + max(level[x], level[y]))
            node.append(level[-1] << 32 | min(node[x] & 0xFFFFFFFF, node[y] & 0xFFFFFFFF))
            merges.append((a, node[-1], node[x], node[y], level[-1], float(lx)))
        leaf += [(a, i, float(w)) for i, w in enumerate(trees.weights(t, n))]
    seqs = spark.createDataFrame([(a, i, f"s{i}", s) for a, rows in sets.items() for i, s in enumerate(rows)], "aln_id string, row_idx int, id string, residues string")
    given = spark.createDataFrame(merges, progressive.TREE), spark.createDataFrame(leaf, "aln_id string, row_idx int, weight double")
    got = {(r["aln_id"], r["row_idx"]): r["residues"] for r in progressive.align_levels(seqs, "protein", tree=given).collect()}
    m, p = matrices.choose("protein"), msa.Params()
    for a, rows in sets.items():
        want = msa.progressive([np.frombuffer(s.encode(), np.uint8) for s in rows], tree[a], trees.weights(tree[a], len(rows)), m, p)
        assert [got[a, i] for i in range(len(rows))] == [r.tobytes().decode() for r in want]


def test_levels_edges(spark):
    """Empty and null rows, gaps, a set of one row, scores and other columns, no rows at all."""
    rows = [("a", 0, "x", "AC-GT", [1, 2, 0, 3, 4], "d", True), ("a", 1, "y", None, None, None, False), ("a", 2, "z", "ACT", [9, 8, 7], "d", False), ("a", 3, "w", "", [], "", False), ("b", 0, "x", "A-C", None, "d", False), ("b", 1, "x", "--", None, "d", False), ("c", 0, "x", "", None, "d", False)]
    df = spark.createDataFrame(rows, "aln_id string, row_idx int, id string, residues string, quality array<smallint>, description string, hidden boolean")
    out = progressive.align_levels(df, "DNA")
    assert out.columns == df.columns
    got = {(r["aln_id"], r["row_idx"]): r for r in out.collect()}
    assert len(got) == 7 and {len(got["a", i]["residues"]) for i in range(4)} == {4}
    assert got["a", 0]["residues"] == "ACGT" and got["a", 0]["quality"] == [1, 2, 3, 4] and got["a", 0]["hidden"]
    z = got["a", 2]
    assert z["residues"].replace("-", "") == "ACT" and [q for c, q in zip(z["residues"], z["quality"], strict=True) if c != "-"] == [9, 8, 7]
    assert got["a", 1]["residues"] == got["a", 3]["residues"] == "----"
    assert [got["b", i]["residues"] for i in range(2)] == ["AC", "--"] and got["c", 0]["residues"] == ""
    assert progressive.align_levels(df.limit(0), "DNA").collect() == []


def test_levels_hold_no_set(spark, monkeypatch):
    """A set of 60 rows: no row that a merge reads has its sequences; a profile is as large as its width, not its rows."""
    rng = random.Random(9)
    seqs = spark.createDataFrame([("a", i, f"s{i}", s) for i, s in enumerate(mutated(rng, 60, 24))], "aln_id string, row_idx int, id string, residues string")
    kept = []
    add = Store.add
    monkeypatch.setattr(Store, "add", lambda self, df, name, *by: (add(self, df, name, *by), kept.append((self, name)))[0])
    out = progressive.align_levels(seqs, "protein").collect()
    assert len({len(r["residues"]) for r in out}) == 1 and len(out) == 60
    assert {r["row_idx"]: r["residues"].replace("-", "") for r in out} == {r["row_idx"]: r["residues"] for r in seqs.collect()}
    profiles = spark.read.parquet(f"{kept[0][0].path}/profiles")
    most = profiles.where("round > 0").agg(F.max(F.length("freq") + F.length("gap"))).first()[0]
    width = len(out[0]["residues"])
    assert most <= width * 4 * 21 + width * 4


@pytest.mark.parametrize("at_once", [0, 9])
def test_small_sets_have_the_tree_of_rounds(spark, sets, monkeypatch, at_once):
    """Sets up to AT_ONCE rows take one stage, larger ones rounds; merges, rounds and weights are the same."""
    d, rows, pairs = sets
    got = []
    for most in (64, at_once):
        monkeypatch.setattr(progressive, "AT_ONCE", most)
        store = Store(spark, "t")
        tree, weights = progressive.guide_rounds(pairs, rows, store)
        got.append(({tuple(m)[:5]: m["height"] for m in tree.collect()}, {(r["aln_id"], r["row_idx"]): r["weight"] for r in weights.collect()}, store.n))
    (one, w, stored), (other, v, _) = got
    assert one.keys() == other.keys() and all(h == pytest.approx(other[m], abs=1e-12) for m, h in one.items())
    assert w.keys() == v.keys() and all(x == pytest.approx(v[r], abs=1e-9) for r, x in w.items())
    assert stored == 3  # no table for each round


def test_profiles_aligned_together():
    """Pairs of profiles of different widths: the steps of each by itself."""
    rng = random.Random(6)
    m, p, np_rng = matrices.choose("protein"), msa.Params(), np.random.default_rng(6)
    profile = lambda k, width: msa.Profile([np.frombuffer("".join(rng.choice("ACDEFG-") for _ in range(width)).encode(), np.uint8) for _ in range(k)], list(range(k)), np_rng.random(k) + 0.1)
    pairs = [(profile(rng.randrange(1, 4), rng.randrange(0, 40)), profile(rng.randrange(1, 4), rng.randrange(0, 40))) for _ in range(60)]
    assert msa.align_profile_pairs(pairs, m, p) == [msa.align_profiles(a, b, m, p) for a, b in pairs]
