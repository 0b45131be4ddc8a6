"""Column statistics, consensus, identities, weights and accuracy: aggregates over cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.alphabet import CORE, GAPS, NUCLEOTIDES, PROTEIN, UNKNOWN
from strandline.functions import scalars as S


def cells(seqs: DataFrame) -> DataFrame:
    """aln_id, row_idx, col, res: one row for each residue that is written out."""
    return seqs.select("aln_id", "row_idx", F.posexplode(S.cells_of(F.col("residues"))).alias("col", "res"))


def shape(seqs: DataFrame) -> DataFrame:
    """aln_id, rows, width, aligned."""
    n = F.length("residues")
    return seqs.groupBy("aln_id").agg(F.count(F.lit(1)).alias("rows"), F.max(n).cast("long").alias("width"), (F.min(n) == F.max(n)).alias("aligned"))


def _all_columns(seqs: DataFrame) -> DataFrame:
    return shape(seqs).where("width > 0").select("aln_id", "rows", F.explode(F.sequence(F.lit(0), (F.col("width") - 1).cast("int"))).alias("col"))


def column_stats(seqs: DataFrame, alphabet: str) -> DataFrame:
    """aln_id, col, occupancy, rows, majority, majority_count, distinct, ambiguous.

    One aggregation by (alignment, column) with a counter for each core symbol: no row is made for a
    symbol, and partial sums meet the shuffle. Ties of the majority go to the first core symbol.
    """
    core = CORE[alphabet]
    u = S.upper(F.col("res"))
    counts = [F.count_if(u == s).alias(f"_{s}") for s in core]
    agg = cells(seqs).where(~F.col("res").isin(*GAPS)).groupBy("aln_id", "col").agg(F.count(F.lit(1)).alias("occupancy"), F.count_if(~u.isin(*core)).alias("ambiguous"), *counts)
    n = [F.col(f"_{s}") for s in core]
    best = F.greatest(*n)
    majority = F.coalesce(*[F.when((c == best) & (best > 0), F.lit(s)) for s, c in zip(core, n, strict=True)])
    distinct = sum((F.when(c > 0, 1).otherwise(0) for c in n), F.lit(0))
    full = _all_columns(seqs).join(agg.select("aln_id", "col", "occupancy", "ambiguous", majority.alias("majority"), best.alias("majority_count"), distinct.alias("distinct")), ["aln_id", "col"], "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("majority_count", "distinct", "ambiguous")]
    return full.select("aln_id", "col", F.coalesce("occupancy", F.lit(0)).cast("long").alias("occupancy"), "rows", "majority", *zero)


def as_float(num: Column, den: Column) -> Column:
    """num / den in single precision; 0 where den is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den).cast("float"), F.lit(0.0).cast("float"))


def with_fractions(stats: DataFrame) -> DataFrame:
    """column_stats() plus occupancy_fraction, identity, conserved and quality."""
    occ, ident = as_float(F.col("occupancy"), F.col("rows")), as_float(F.col("majority_count"), F.col("occupancy"))
    conserved = (F.col("occupancy") == F.col("rows")) & (F.col("majority_count") == F.col("rows")) & (F.col("rows") > 0)
    return stats.withColumns({"occupancy_fraction": occ, "identity": ident, "conserved": conserved, "quality": (occ * ident).cast("float")})


def consensus(seqs: DataFrame, alphabet: str, threshold: float = 0.5, min_occupancy: float = 0.05) -> DataFrame:
    """aln_id, residues: the majority where it is frequent enough, else N or X; '-' in sparse columns."""
    s = with_fractions(column_stats(seqs, alphabet))
    res = F.when((F.col("occupancy") == 0) | (F.col("occupancy_fraction") < F.lit(min_occupancy).cast("float")), "-").when(F.col("majority").isNotNull() & (F.col("identity") >= F.lit(threshold).cast("float")), F.col("majority")).otherwise(UNKNOWN[alphabet])
    cols = s.select("aln_id", F.struct("col", res.alias("res")).alias("c"))
    return cols.groupBy("aln_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x["res"]), "").alias("residues"))


def conserved_fraction(seqs: DataFrame, alphabet: str) -> DataFrame:
    return with_fractions(column_stats(seqs, alphabet)).groupBy("aln_id").agg(F.avg(F.col("conserved").cast("int")).alias("conserved_fraction"))


def summary(seqs: DataFrame, alphabet: str) -> DataFrame:
    """One row for each alignment: rows, columns, share of identical columns, all-gap columns, mean residues and ambiguity."""
    per_row = seqs.groupBy("aln_id").agg(F.avg(S.ungapped_length(F.col("residues"))).alias("mean_residues"), F.avg(S.ambiguity_fraction(F.col("residues"), alphabet)).alias("mean_ambiguity"))
    per_col = with_fractions(column_stats(seqs, alphabet)).groupBy("aln_id").agg(F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"), F.avg(F.col("conserved").cast("int")).alias("conserved_fraction"), F.count_if(F.col("occupancy") == 0).alias("all_gap_columns"))
    return per_col.join(per_row, "aln_id")


def alphabet_guess(seqs: DataFrame, rows: int = 100, residues: int = 5000) -> DataFrame:
    """aln_id, alphabet, from the first rows and residues of each alignment (the sample is the operator's)."""
    r = S.upper(F.substring("residues", 1, residues))
    r = F.regexp_replace(r, r"[-?\s0-9]", "")
    part = seqs.where(F.col("row_idx") < rows).select("aln_id", F.length(r).alias("n"), (F.length(r) - F.length(S.without(r, "ACGTUN"))).alias("nuc"), (F.length(r) - F.length(S.without(r, "U"))).alias("u"), (F.length(r) - F.length(S.without(r, "T"))).alias("t"))
    total = part.groupBy("aln_id").agg(*[F.sum(c).alias(c) for c in ("n", "nuc", "u", "t")])
    nucleic = (F.col("n") == 0) | (F.try_divide(F.col("nuc").cast("double"), F.col("n")) >= 0.85)
    return total.select("aln_id", F.when(nucleic & (F.col("u") > F.col("t")), "RNA").when(nucleic, "DNA").otherwise("protein").alias("alphabet"))


def pairs(seqs: DataFrame) -> DataFrame:
    """aln_id, i, j, a, b: rows of one alignment with i > j. An equi-join on the alignment with a residual."""
    a, b = (seqs.select("aln_id", F.col("row_idx").alias(i), S.upper(S.normalize(F.col("residues"))).alias(r)) for i, r in (("i", "a"), ("j", "b")))
    return a.join(b, "aln_id").where("i > j")


def match_counts(seqs: DataFrame) -> DataFrame:
    """aln_id, i, j, both, same: positions where neither row has a gap, and where they agree, for all pairs."""
    zipped = F.zip_with(S.cells_of(F.col("a")), S.cells_of(F.col("b")), lambda x, y: F.when(x.isNull() | y.isNull() | (x == "-") | (y == "-"), 0).when(x == y, 2).otherwise(1))
    p = pairs(seqs).withColumn("_z", zipped)
    return p.select("aln_id", "i", "j", F.size(F.filter("_z", lambda v: v > 0)).cast("long").alias("both"), F.size(F.filter("_z", lambda v: v == 2)).cast("long").alias("same"))


def pairwise_identity(seqs: DataFrame) -> DataFrame:
    """identity is null where two rows share no occupied column."""
    return match_counts(seqs).select("aln_id", "i", "j", F.try_divide(F.col("same").cast("double"), F.col("both")).cast("float").alias("identity"))


def mean_pairwise_identity(seqs: DataFrame) -> DataFrame:
    return pairwise_identity(seqs).groupBy("aln_id").agg(F.avg(F.col("identity").cast("double")).alias("mean_identity"))


def henikoff_weights(seqs: DataFrame) -> DataFrame:
    """aln_id, row_idx, weight: position-based weights with the gap as a kind of its own; mean 1, at least 1e-4.

    Columns in which all rows agree don't count; where no column counts all weights are 1.
    """
    width = shape(seqs).select("aln_id", "width")
    padded = seqs.join(width, "aln_id").select("aln_id", "row_idx", S.pad(S.upper(S.normalize(F.col("residues"))), F.col("width")).alias("residues"))
    slot = F.when(F.col("res").between("A", "Z"), F.col("res")).when(F.col("res") == "-", "-").otherwise("X")
    c = cells(padded).withColumn("slot", slot)
    per = c.groupBy("aln_id", "col", "slot").agg(F.count(F.lit(1)).alias("n"))
    kinds = per.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("aln_id", "col"))).where("k > 1")
    share = c.join(kinds, ["aln_id", "col", "slot"]).groupBy("aln_id", "row_idx").agg(F.sum(1.0 / (F.col("k") * F.col("n"))).alias("raw"))
    all_rows = seqs.select("aln_id", "row_idx").join(share, ["aln_id", "row_idx"], "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    mean = F.avg("raw").over(Window.partitionBy("aln_id"))
    return all_rows.withColumn("m", mean).select("aln_id", "row_idx", F.when(F.col("m") > 0, F.greatest(F.col("raw") / F.col("m"), F.lit(1e-4))).otherwise(1.0).alias("weight"))


def residue_positions(seqs: DataFrame) -> DataFrame:
    """aln_id, row_idx, col, pos: the number of each residue in its ungapped row."""
    order = Window.partitionBy("aln_id", "row_idx").orderBy("col")
    return cells(seqs).where(~F.col("res").isin(*GAPS)).withColumn("pos", F.row_number().over(order) - 1).drop("res")


def accuracy(test: DataFrame, truth: DataFrame) -> DataFrame:
    """aln_id, sp, tc: the share of the true residue pairs, and of the true columns, that the test has.

    Pairs are counted by groups of residues that share a column in both, so no pair is made.
    """
    t, r = residue_positions(test).withColumnRenamed("col", "test_col"), residue_positions(truth).withColumnRenamed("col", "true_col")
    both = r.join(t, ["aln_id", "row_idx", "pos"], "left")
    choose = F.col("n") * (F.col("n") - 1) / 2
    per = both.groupBy("aln_id", "true_col", "test_col").agg(F.count(F.lit(1)).alias("n"))
    kept = per.where(F.col("test_col").isNotNull()).groupBy("aln_id").agg(F.sum(choose).alias("kept"))
    whole = per.groupBy("aln_id", "true_col").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    all_ = whole.where("n > 1").groupBy("aln_id").agg(F.sum(choose).alias("pairs"), F.count(F.lit(1)).alias("columns"), F.count_if(F.col("parts") == 1).alias("exact"))
    return all_.join(kept, "aln_id", "left").select("aln_id", F.try_divide(F.coalesce("kept", F.lit(0.0)), F.col("pairs")).alias("sp"), F.try_divide(F.col("exact").cast("double"), F.col("columns")).alias("tc"))


def nucleotide(alphabet: str) -> bool:
    return alphabet != PROTEIN and set(CORE[alphabet]) <= set(NUCLEOTIDES)
