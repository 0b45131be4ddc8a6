"""Text views of an alignment: what a screen would show, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import scalars as S


def viewport(seqs: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """The rows and columns in two ranges (ends exclusive): a row filter and a slice."""
    here = seqs.where((F.col("row_idx") >= rows[0]) & (F.col("row_idx") < rows[1]))
    return here.withColumn("residues", F.substring("residues", cols[0] + 1, max(0, cols[1] - cols[0])))


def dots(seqs: DataFrame, consensus: DataFrame) -> DataFrame:
    """Rows in which residues equal to the consensus (aln_id, residues) are dots."""
    c = consensus.select("aln_id", S.cells_of(F.col("residues")).alias("_c"))
    shown = F.transform(S.cells_of(F.col("residues")), lambda x, i: F.when((S.upper(x) == F.get("_c", i)) & ~S.is_gap(x), ".").otherwise(x))
    return seqs.join(c, "aln_id").withColumn("residues", F.array_join(shown, "")).select(*seqs.columns)


def column_at(seqs: DataFrame, number: int) -> DataFrame:
    """aln_id, row_idx, res of the column with this number (from 1); rows that end before it have a gap."""
    at = max(1, number)
    return seqs.select("aln_id", "row_idx", F.when(F.length("residues") >= at, F.substring("residues", at, 1)).otherwise("-").alias("res"))


def class_runs(seqs: DataFrame, alphabet: str) -> DataFrame:
    """aln_id, row_idx, start, end (exclusive), class: maximal runs of one colour class along each row. No shuffle."""
    classes = F.transform(S.cells_of(F.col("residues")), lambda x: S.residue_class(x, alphabet))
    c = seqs.where(F.length("residues") > 0).select("aln_id", "row_idx", classes.alias("_c"))
    beside = F.arrays_zip(F.col("_c").alias("c"), F.concat(F.array(F.lit(None).cast("string")), "_c").alias("b"), F.sequence(F.lit(0), F.size("_c")).alias("start"))
    # The last of these stands after the row and ends its last run.
    edge = F.filter(beside, lambda x: x["c"].isNull() | x["b"].isNull() | (x["c"] != x["b"]))
    c = c.select("aln_id", "row_idx", edge.alias("_e"))
    runs = F.arrays_zip(F.col("_e").alias("e"), F.slice("_e", 2, F.size("_e") - 1).alias("n"))
    r = c.select("aln_id", "row_idx", F.explode(F.slice(runs, F.lit(1), F.size("_e") - 1)).alias("r"))
    return r.select("aln_id", "row_idx", "r.e.start", F.col("r.n.start").alias("end"), F.col("r.e.c").alias("class"))
