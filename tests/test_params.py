"""Choices of table, distance and tree, weights of profiles, scores that follow residues."""

import numpy as np
import pytest

from strandline.errors import AlgorithmError
from strandline.kernels import matrices, msa
from strandline.operators import align, edits, stats

#: A table in the published layout, made up: 6 on the diagonal, -2 elsewhere.
LETTERS = "ARNDCQEGHILKMFPSTWYVBZX*"
TABLE = "# made up\n   " + "  ".join(LETTERS) + "\n" + "\n".join(a + " " + " ".join(" 6" if a == b else "-2" for b in LETTERS) for a in LETTERS) + "\n"


def test_table_from_a_file(spark, tmp_path):
    (tmp_path / "MADE").write_text(TABLE)
    m = matrices.read(spark, str(tmp_path / "MADE"))
    assert m.name == "MADE" and m.table[ord("W"), ord("w")] == 6 and m.table[ord("W"), ord("C")] == -2
    rows = ["ACDEFGHIK", "ACDFGHIK", "CDEFGHK"]
    a = msa.align(rows, "protein", msa.Params(table=m))
    assert len({len(r) for r in a}) == 1 and [r.replace("-", "") for r in a] == rows


def test_distance_and_tree_are_parameters(monkeypatch):
    rows = ["ACDEFGHIKLMN", "ACDEFGHIKLMN", "ACDFGHIKLM", "WYVTSWYVTS", "WYVTSRWYVTS"]
    seen = []
    for name in ("kmer_distances", "pairwise_distances"):
        real = getattr(msa, name)
        monkeypatch.setattr(msa, name, lambda *x, real=real, name=name: seen.append(name) or real(*x))
    for engine in ("clustal", "muscle"):
        for distance in ("kmer", "pairwise"):
            for tree in ("nj", "upgma"):
                seen.clear()
                out = msa.align(rows, "protein", msa.Params(engine, distance=distance, tree=tree))
                assert seen == [f"{distance}_distances"] and [r.replace("-", "") for r in out] == rows
    d = np.random.default_rng(1).random((7, 7))
    assert msa.guide_tree(d + d.T, msa.Params("muscle", tree="nj")) == msa.trees.neighbor_joining(d + d.T)
    with pytest.raises(AlgorithmError):
        msa.Params(tree="star")


def test_weights_are_those_of_the_operator(spark):
    rows = ["ACDE-", "ACDEF", "AC--F", "WCDEF"]
    df = spark.createDataFrame([("a", i, r) for i, r in enumerate(rows)], "aln_id string, row_idx int, residues string")
    want = {r["row_idx"]: r["weight"] for r in stats.henikoff_weights(df).collect()}
    assert np.allclose(msa.henikoff([np.frombuffer(r.encode(), np.uint8) for r in rows]), [want[i] for i in range(4)])


def test_ragged_base(spark):
    out = msa.add_to(["ACDEFG", "ACDE", ""], ["CDEF", "ADEFG"], "protein")
    assert len({len(r) for r in out}) == 1 and [r.replace("-", "") for r in out] == ["ACDEFG", "ACDE", "", "CDEF", "ADEFG"]


def test_other_columns_stay(spark):
    rows = [("a", 0, "x", "AC-GT", [1, 2, 0, 3, 4], "d", True), ("a", 1, "y", "ACT", [9, 8, 7], "e", False), ("a", 2, "z", "ACGT", None, "", False)]
    df = spark.createDataFrame(rows, "aln_id string, row_idx int, id string, residues string, quality array<smallint>, description string, hidden boolean")
    got = align.align(df, "DNA").orderBy("row_idx").collect()
    assert [(r["description"], r["hidden"]) for r in got] == [("d", True), ("e", False), ("", False)]
    assert got[0]["quality"] == [1, 2, 3, 4] and got[2]["quality"] is None
    assert [q for c, q in zip(got[1]["residues"], got[1]["quality"], strict=True) if c != "-"] == [9, 8, 7]
    with pytest.raises(AlgorithmError):
        edits.reverse_complement_rows(df, [0], "protein")
