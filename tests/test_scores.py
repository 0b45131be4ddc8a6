"""The sum of pairs by columns against all pairs, one by one."""

import itertools
import random

import numpy as np
import pytest

from strandline.kernels import matrices, msa
from strandline.operators import scores


def by_pairs(rows, w, m, p):
    scale, width = m.mean_diagonal / 5.8, max(map(len, rows))
    rows = [r.ljust(width, "-") for r in rows]
    total = 0.0
    for (a, wa), (b, wb) in itertools.combinations(list(zip(rows, w, strict=True)), 2):
        for c in range(width):
            x, y = a[c], b[c]
            if x != "-" and y != "-":
                total += wa * wb * float(m.table[ord(x), ord(y)])
            elif x != y:
                gap, other = (a, b) if x == "-" else (b, a)
                goes_on = c == 0 or gap[c - 1] == "-" and other[c - 1] != "-"
                terminal = not gap[:c].strip("-") or not gap[c:].strip("-")
                total -= wa * wb * (p.terminal if terminal else 1) * scale * (p.extend + (0 if goes_on else p.open))
    return total


@pytest.mark.parametrize("alphabet", ["protein", "DNA"])
def test_sum_of_pairs(spark, alphabet):
    rng = random.Random(3)
    letters = "ACDEFGHIKLMNPQRSTVWY" if alphabet == "protein" else "ACGTN"
    sets, w = {}, {}
    for k in range(6):
        sets[str(k)] = ["".join(rng.choice("-" * 4 + letters if rng.random() < 0.6 else "-") for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 8))]
        w[str(k)] = [rng.uniform(0.2, 2) for _ in sets[str(k)]]
    sets["gaps"], w["gaps"] = ["---", "---"], [1.0, 1.0]
    df = spark.createDataFrame([(a, i, r) for a, rows in sets.items() for i, r in enumerate(rows)], "aln_id string, row_idx int, residues string")
    weights = spark.createDataFrame([(a, i, x) for a, ws in w.items() for i, x in enumerate(ws)], "aln_id string, row_idx int, weight double")
    m, p = matrices.choose(alphabet), msa.Params()
    got = {r["aln_id"]: r["score"] for r in scores.sum_of_pairs(df, alphabet, weights=weights).collect()}
    for a, rows in sets.items():
        assert got[a] == pytest.approx(by_pairs(rows, w[a], m, p), abs=1e-6), a
    width = max(map(len, sets["1"]))
    even = [np.frombuffer(r.ljust(width, "-").encode(), np.uint8) for r in sets["1"]]
    assert got["1"] == pytest.approx(msa.sp_score(even, np.array(w["1"]), m, p), rel=1e-5, abs=1e-3)
    ones = {r["aln_id"]: r["score"] for r in scores.sum_of_pairs(df, alphabet).collect()}
    assert ones["2"] == pytest.approx(by_pairs(sets["2"], [1.0] * len(w["2"]), m, p), abs=1e-6) and scores.sum_of_pairs(df.limit(0), alphabet).collect() == []
