"""Work on rows and sets that follows the input: scores by numpy, sets over all cores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import scores
from strandline.kernels import matrices, msa
from strandline.operators import align


def test_scores(spark):
    rows = [("A-C", [1, 2, 4], 2.5), ("é.C~", [1, 2, 4, 9], 2.5), ("AC", [1], None), ("A-", [3], 3.0), ("A", [3, 50], 3.0), ("--", [1, 1], None), ("", [], None), (None, [1], None), ("A", None, None), ("AC", [1, None], None), ("A-", [7, None], 7.0)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, r string, q array<smallint>, want double").coalesce(1)
    assert [x[0] for x in d.orderBy("k").select(scores.mean_quality("r", "q")).collect()] == [r[2] for r in rows]
    assert [x[0] for x in d.orderBy("k").select(scores.scores("r", F.lit(50))).limit(3).collect()] == [[15, 0, 17], [183, 0, 17, 76], [15, 17]]
    assert d.where("k in (6, 7)").orderBy("k").select(scores.scores("r", F.lit(33))).collect() == [([],), (None,)]


def test_quality_mean_makes_no_value_for_each_letter(spark, sf):
    import __spark_entry__ as entry

    plan = entry.queries()["quality_mean"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan


def test_small_sets_are_not_put_into_one_task(spark):
    d = spark.createDataFrame([(f"s{i}", r, "", "ACDEFG"[: 4 + r]) for i in range(24) for r in range(2)], "aln_id string, row_idx int, id string, residues string")
    for out in (align.align(d, "protein", "muscle"), align.realign_region(d, 0, 3, "protein")):
        assert out.select("aln_id", F.spark_partition_id().alias("p")).select("p").distinct().count() > 4
        assert out.groupBy("aln_id").agg(F.count_distinct(F.length("residues")).alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_sum_of_pairs_by_columns(seed):
    """The weighted sum over all pairs of rows."""
    rng = np.random.default_rng(seed)
    rows = [np.frombuffer(b"ACDEF---", np.uint8)[rng.integers(0, 8, 30)] for _ in range(5)]
    w, m, p = rng.random(5) + 0.1, matrices.choose("protein"), msa.Params()
    scale, want = m.mean_diagonal / 5.8, 0.0
    gap = [r == ord("-") for r in rows]
    outer = [np.array([g[c] and (g[: c + 1].all() or g[c:].all()) for c in range(30)]) for g in gap]
    for i in range(5):
        for j in range(i):
            for c in range(30):
                x, y = (i, j) if gap[i][c] else (j, i)
                if gap[i][c] != gap[j][c]:
                    goes_on = gap[x][max(c - 1, 0)] and not gap[y][max(c - 1, 0)]
                    want -= w[i] * w[j] * scale * (p.terminal if outer[x][c] else 1.0) * (p.extend + (0 if goes_on else p.open))
                elif not gap[i][c]:
                    want += w[i] * w[j] * m.table[rows[i][c], rows[j][c]]
    assert msa.sp_score(rows, w, m, p) == pytest.approx(want, rel=1e-6)


def test_scores_of_whole_batches():
    """Batches of rows, sliced or not, with nulls, other letters and too few or too many scores, against rows one by one."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    rows, marks, lists = [], [], []
    for i in range(400):
        n = int(rng.integers(0, 12))
        rows.append(None if i % 17 == 3 else "".join(rng.choice(list("ACD-.~é" if i % 5 == 1 else "ACD-.~"), n)))
        marks.append(None if i % 13 == 2 else "".join(rng.choice(list("!5AZ~é" if i > 200 else "!5AZ~"), n)))
        m = n if i < 100 or rng.random() < 0.7 else int(rng.integers(0, 14))
        lists.append(None if i % 19 == 4 else [None if i > 150 and rng.random() < 0.05 else int(x) for x in rng.integers(0, 90, m)])

    def mean(r, q):
        at = [k for k, c in enumerate(r or "") if c not in "-.~"]
        if r is None or q is None or not at or any(k >= len(q) or q[k] is None for k in at):
            return None
        return sum(q[k] for k in at) / len(at)

    r, q, k = pa.array(rows, pa.string()), pa.array(lists, pa.list_(pa.int16())), pa.array([33 if i % 3 else 64 for i in range(400)], pa.int32())
    for lo, n in ((0, 400), (0, 90), (7, 60), (160, 200), (5, 0)):
        some = slice(lo, lo + n)
        assert scores.mean_of(r.slice(lo, n), q.slice(lo, n)).to_pylist() == [mean(a, b) for a, b in zip(rows[some], lists[some], strict=True)]
        for off in (k, pa.array([33] * 400, pa.int32())):
            want = [None if m is None else [max(ord(c) - o, 0) for c in m] for m, o in zip(marks[some], off.to_pylist()[some], strict=True)]
            assert scores.scores_of(pa.array(marks, pa.string()).slice(lo, n), off.slice(lo, n)).to_pylist() == want
    with pytest.raises(OverflowError):
        scores.scores_of(pa.array(["\U0001f600"]), pa.array([33], pa.int32()))
