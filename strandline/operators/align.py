"""Alignment operators: numpy kernels run for each pair or alignment in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.alphabet import GAPS, PROTEIN
from strandline.functions import scalars as S
from strandline.kernels import matrices, msa, pairwise, trees
from strandline.operators.stats import pairs
from strandline.session import ship_code


def pairwise_align(seqs: DataFrame, alphabet: str, mode: str = "global", open: float = 10.0, extend: float = 0.5, terminal: float = 1.0) -> DataFrame:
    """aln_id, i, j, row_i, row_j, score of all pairs of rows (gaps in them don't count); of local alignments also
    the ranges start_i, end_i, start_j, end_j of what they align, in residues.

    The pairs are dealt anew before the kernel, as their cost doesn't show in their size.
    """
    ship_code(seqs.sparkSession)
    table = matrices.choose(alphabet).table
    p = pairs(seqs).withColumns({"a": S.ungapped(F.col("a")), "b": S.ungapped(F.col("b"))}).repartition("aln_id", "i", "j")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            both = list(zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True))
            out = pairwise.global_pairs(both, table, open, extend, terminal) if mode == "global" else pairwise.local_pairs(both, table, open, extend)
            cols = [pa.array([o[k] for o in out], pa.string() if k < 2 else pa.float64() if k == 2 else pa.int32()) for k in range(3 + len(ranges))]
            yield pa.RecordBatch.from_arrays([x.column("aln_id"), x.column("i"), x.column("j"), *cols], ["aln_id", "i", "j", "row_i", "row_j", "score", *ranges])

    ranges = () if mode == "global" else ("start_i", "end_i", "start_j", "end_j")
    schema = "aln_id string, i int, j int, row_i string, row_j string, score double" + "".join(f", {r} int" for r in ranges)
    return p.select("aln_id", "i", "j", "a", "b").mapInArrow(kernel, schema)


def pairwise_distance(seqs: DataFrame, alphabet: str) -> DataFrame:
    """aln_id, i, j, d: corrected distance after global alignment of each pair."""
    scale = matrices.choose(alphabet).mean_diagonal / 5.8
    al = pairwise_align(seqs, alphabet, "global", 10.0 * scale, 0.5 * scale)
    z = F.zip_with(S.cells_of(S.upper(F.col("row_i"))), S.cells_of(S.upper(F.col("row_j"))), lambda x, y: F.when((x == "-") | (y == "-"), 0).when(x == y, 2).otherwise(1))
    n = al.withColumn("_z", z).select("aln_id", "i", "j", F.size(F.filter("_z", lambda v: v > 0)).alias("both"), F.size(F.filter("_z", lambda v: v == 1)).alias("diff"))
    p = F.coalesce(F.try_divide(F.col("diff").cast("double"), F.col("both")), F.lit(0.0))
    return n.select("aln_id", "i", "j", (S.kimura_protein(p) if alphabet == PROTEIN else S.jukes_cantor(p)).alias("d"))


def guide_trees(dist: DataFrame, names: DataFrame, method: str = "nj") -> DataFrame:
    """aln_id, newick, leaves. dist: aln_id, i, j, d; names: aln_id, row_idx, id (rows numbered from 0)."""
    ship_code(dist.sparkSession)

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("row_idx")
        place = {r: k for k, r in enumerate(right["row_idx"])}
        n = len(right)
        d = trees.square(n, left["i"].map(place).to_numpy(np.int64), left["j"].map(place).to_numpy(np.int64), left["d"].to_numpy(float)) if len(left) else np.zeros((n, n))
        return pd.DataFrame({"aln_id": [right["aln"].iloc[0]], "newick": [trees.newick(trees.build(d, method), list(right["id"]))], "leaves": [n]}) if n else pd.DataFrame({"aln_id": [], "newick": [], "leaves": []})

    return dist.groupBy("aln_id").cogroup(names.select(F.col("aln_id").alias("aln"), "row_idx", "id").groupBy("aln")).applyInPandas(kernel, "aln_id string, newick string, leaves long")


def align(seqs: DataFrame, alphabet: str, engine: str = "clustal", params: msa.Params | None = None) -> DataFrame:
    """Each set aligned as a whole in one task; sets are independent (progressive.align_levels spreads a large one).

    All columns of seqs stay; quality is in step with the residues, 0 at gaps. params.distance and params.tree choose how the
    guide tree comes about: by default the clustal engine takes pairwise alignments up to msa.PAIRWISE_CELLS and neighbour
    joining up to trees.MOST_JOINED rows, and k-mers and average linkage beyond, as the other engines always do.
    """
    ship_code(seqs.sparkSession)
    p = params or msa.Params.of(engine)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx")
        before = [r or "" for r in pdf["residues"]]
        rows = msa.align(before, alphabet, p)
        out = pdf.assign(residues=rows)
        return out.assign(quality=[regapped(*x) for x in zip(before, rows, pdf["quality"], strict=True)]) if "quality" in pdf.columns else out

    return _dealt(seqs).groupBy("aln_id").applyInPandas(kernel, seqs.schema)


def _dealt(seqs: DataFrame) -> DataFrame:
    """Sets over all cores: their cost doesn't show in their bytes, by which Spark would put small partitions together."""
    spark = seqs.sparkSession
    return seqs.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "aln_id")


def regapped(before: str, after: str, quality) -> list[int] | None:
    """Scores (of all cells, or of residues alone) moved with the residues from one gapped form of a row to another."""
    if quality is None:
        return None
    kept = [q for c, q in zip(before, quality, strict=True) if c not in GAPS] if len(quality) == len(before) else list(quality)
    own = iter(kept)
    return [int(next(own, 0)) if c not in GAPS else 0 for c in after]


def realign_region(seqs: DataFrame, start: int, end: int, alphabet: str, params: msa.Params | None = None) -> DataFrame:
    ship_code(seqs.sparkSession)
    p = params or msa.Params()

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx")
        return pdf.assign(residues=msa.realign_columns(list(pdf["residues"]), start, end, alphabet, p))

    return _dealt(seqs.select("aln_id", "row_idx", "id", "residues")).groupBy("aln_id").applyInPandas(kernel, "aln_id string, row_idx int, id string, residues string")


def add_to_alignment(base: DataFrame, queries: DataFrame, alphabet: str, params: msa.Params | None = None) -> DataFrame:
    ship_code(base.sparkSession)
    p = params or msa.Params()
    keys = ["aln_id", "row_idx", "id", "residues"]

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("row_idx"), right.set_axis(keys, axis=1).sort_values("row_idx")
        both = pd.concat([left, right])
        if len(left) and len(right):
            both = both.assign(residues=msa.add_to(list(left["residues"]), list(right["residues"]), alphabet, p))
        return both.assign(row_idx=np.arange(len(both), dtype=np.int32))

    return base.select(*keys).groupBy("aln_id").cogroup(queries.select(*[F.col(k).alias(f"q_{k}") for k in keys]).groupBy("q_aln_id")).applyInPandas(kernel, "aln_id string, row_idx int, id string, residues string")
