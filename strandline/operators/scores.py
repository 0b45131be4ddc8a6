"""The sum-of-pairs score of alignments, by columns: no pair of rows is made."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import scalars as S
from strandline.kernels import matrices, msa
from strandline.operators.stats import shape


def table_rows(seqs: DataFrame, m: matrices.Matrix) -> DataFrame:
    """x, y, s: the scores of a table that aren't 0."""
    at = [(chr(a), chr(b), float(m.table[a, b])) for a, b in zip(*np.nonzero(m.table), strict=True)]
    return seqs.sparkSession.createDataFrame(at, "x string, y string, s double")


def sum_of_pairs(seqs: DataFrame, alphabet: str, params: msa.Params | None = None, weights: DataFrame | None = None) -> DataFrame:
    """aln_id, pairs, gaps, score (pairs - gaps): each two rows' residues by the table, times both weights, less their gaps.

    A gap against a residue costs its extension, and its opening where the gap row had no gap before it or the other row had
    one (none in the first column: such a gap comes from outside); gaps before a row's first and after its last residue cost params.terminal of that. weights: aln_id, row_idx, weight
    (1 if not given). Rows shorter than the widest read as gaps; columns of gaps alone score 0.

    A column's score follows from the weights that share a letter, and from those in six states: residues by whether a gap
    stands before them, gaps by that and by whether they are terminal. So one aggregation by column and letter is all
    that is shuffled, and rows of an alignment meet nowhere.
    """
    params = params or msa.Params()
    m = params.scores(alphabet)
    scale = m.mean_diagonal / msa._REFERENCE
    width = shape(seqs).select("aln_id", "width")
    rows = seqs.join(width, "aln_id").select("aln_id", "row_idx", S.pad(S.normalize(F.coalesce("residues", F.lit(""))), F.col("width")).alias("r"))
    rows = rows.join(weights.select("aln_id", "row_idx", "weight"), ["aln_id", "row_idx"]) if weights is not None else rows.withColumn("weight", F.lit(1.0))
    lead = F.length(F.regexp_extract("r", "^-*", 0))
    tail = F.length("r") - F.length(F.regexp_extract("r", "-*$", 0))
    cells = S.cells_of(F.col("r"))
    before = F.concat(F.slice(cells, 1, 1), F.slice(cells, F.lit(1), F.greatest(F.size(cells) - 1, F.lit(0))))
    each = rows.select("aln_id", "weight", lead.alias("lead"), tail.alias("tail"), F.posexplode(F.arrays_zip(cells.alias("x"), before.alias("b"))).alias("col", "c"))
    each = each.select("aln_id", "col", F.col("c.x").alias("x"), F.col("c.b") == "-", "weight", (F.col("col") < F.col("lead")) | (F.col("col") >= F.col("tail"))).toDF("aln_id", "col", "x", "after", "weight", "terminal")
    gap = F.col("x") == "-"
    kind = each.groupBy("aln_id", "col", "x", "after", (gap & F.col("terminal")).alias("terminal")).agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("weight")).alias("w2"))
    # Letters of a column: at most as many as the table has.
    letters = kind.where(~gap).groupBy("aln_id", "col", "x").agg(F.sum("w").alias("w"), F.sum("w2").alias("w2"))
    other = letters.select("aln_id", "col", F.col("x").alias("y"), F.col("w").alias("v"))
    table = F.broadcast(table_rows(seqs, m))  # the table's size
    met = letters.join(other, ["aln_id", "col"]).join(table, ["x", "y"])
    own = F.when(F.col("x") == F.col("y"), F.col("w2")).otherwise(0.0)
    pairs = met.groupBy("aln_id").agg(F.sum(0.5 * F.col("s") * (F.col("w") * F.col("v") - own)).alias("pairs"))
    total = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0.0))
    after, terminal = F.col("after"), F.col("terminal")
    states = kind.groupBy("aln_id", "col").agg(
        total(~gap & after).alias("ra"), total(~gap & ~after).alias("rn"), total(gap & after & terminal).alias("gat"), total(gap & after & ~terminal).alias("ga"), total(gap & ~after & terminal).alias("gnt"), total(gap & ~after & ~terminal).alias("gn")
    )
    going, fresh = F.col("ga") + params.terminal * F.col("gat"), F.col("gn") + params.terminal * F.col("gnt")
    residues = F.col("ra") + F.col("rn")
    # Only a gap that goes on against a row without a gap before goes free of its opening.
    cost = scale * (params.extend * (going + fresh) * residues + params.open * (fresh * residues + going * F.col("ra")))
    gaps = states.groupBy("aln_id").agg(F.sum(cost).alias("gaps"))
    out = gaps.join(pairs, "aln_id", "left").select("aln_id", F.coalesce("pairs", F.lit(0.0)).alias("pairs"), "gaps")
    return out.withColumn("score", F.col("pairs") - F.col("gaps"))
