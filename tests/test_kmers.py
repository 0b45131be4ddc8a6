"""k-mers are counted beside their rows, and their distances block by block, with the rows of plain counting."""

import random
from collections import Counter

import pytest

from strandline.alphabet import GROUPS, KMER
from strandline.operators import distances

SETS = "aln_id string, row_idx int, residues string"


def counted(s, k, alphabet):
    groups = GROUPS if alphabet == "protein" else ("A", "C", "G", "TU")
    to = {c: g[0] for g in groups for x in g for c in (x, x.lower())}
    s = "".join(to.get(c, ".") for c in s or "")
    return Counter(w for i in range(len(s) - k + 1) if "." not in (w := s[i : i + k]))


def distance(x, y):
    least = min(x.total(), y.total())
    return 1.0 if least == 0 else max(0.0, min(1.0, 1 - (x & y).total() / least))


def some(n, letters, sets="ab"):
    rng = random.Random(n)
    return [(a, i, "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 40, 200])))) for a in sets for i in range(n)]


@pytest.mark.parametrize(("alphabet", "k"), [("DNA", None), ("DNA", 20), ("protein", None), ("protein", 40)])
def test_counts_and_distances(spark, monkeypatch, alphabet, k):
    monkeypatch.setattr(distances, "BLOCK_ROWS", 4)  # sets of several blocks
    rows = [*some(11, "ACGTUacgtN-" if alphabet == "DNA" else "ACDEFGHIKLMNPQRSTVWYXgé-"), ("c", 3, None), ("c", 9, "ACGTACGTAC" * 9), ("d", 0, "A")]
    df, of = spark.createDataFrame(rows, SETS), {(a, i): counted(s, k or KMER[alphabet], alphabet) for a, i, s in rows}
    got = {(r.aln_id, r.row_idx, r.kmer): r.n for r in distances.kmer_counts(df, alphabet, k).collect()}
    assert got == {(*key, w): n for key, c in of.items() for w, n in c.items()}
    d = [tuple(r) for r in distances.kmer_distance(df, alphabet, k).select("aln_id", "i", "j", "d").collect()]
    want = {(a, i, j): distance(of[a, i], of[a, j]) for a, i in of for b, j in of if a == b and i > j}
    assert len(d) == len(want) and {x[:3]: round(x[3], 12) for x in d} == {x: round(v, 12) for x, v in want.items()}


def test_rows_of_one_key_count_together(spark):
    df = spark.createDataFrame([("a", 0, "AAAAAA"), ("a", 0, "AAAAAAA")], SETS)
    assert [tuple(r) for r in distances.kmer_counts(df, "DNA").collect()] == [("a", 0, "AAAAAA", 3)]


def test_kmers_are_not_shuffled(spark):
    """No row is made for a k-mer before or at a shuffle; a set of many rows is no single group."""
    df = spark.createDataFrame(some(130, "ACGT", "a"), SETS)
    for out in (distances.kmer_counts(df, "DNA"), distances.kmer_distance(df, "DNA")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "transform(" not in plan and "kmer#" not in plan.partition("MapInArrow")[2].partition("\n")[2]
    assert distances.kmer_distance(df, "DNA").count() == 130 * 129 // 2
