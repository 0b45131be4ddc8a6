"""Distances between the rows of an alignment or set: p-distance, corrections, k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.alphabet import KMER, PROTEIN
from strandline.functions import scalars as S
from strandline.kernels import kmers
from strandline.operators.stats import match_counts
from strandline.session import ship_code


def p_distance(seqs: DataFrame) -> DataFrame:
    """aln_id, i, j, p: share of differing residues among positions both rows occupy; 0 where there is none."""
    return match_counts(seqs).select("aln_id", "i", "j", F.coalesce(F.try_divide((F.col("both") - F.col("same")).cast("double"), F.col("both")), F.lit(0.0)).alias("p"))


def corrected(seqs: DataFrame, alphabet: str) -> DataFrame:
    """aln_id, i, j, d: Jukes-Cantor for nucleotides, Kimura's formula for proteins."""
    d = S.kimura_protein(F.col("p")) if alphabet == PROTEIN else S.jukes_cantor(F.col("p"))
    return p_distance(seqs).select("aln_id", "i", "j", d.alias("d"))


def kmer_counts(seqs: DataFrame, alphabet: str, k: int | None = None) -> DataFrame:
    """aln_id, row_idx, kmer, n.

    A row's k-mers are counted where the row is, so that its residues are shuffled (rows with one key meet) and never its k-mers.
    """
    k = k or KMER[alphabet]
    ship_code(seqs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, number, n, words in kmers.kmer_counts(b.column("residues"), k, alphabet):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column("aln_id").take(at), b.column("row_idx").take(at), kmers.spelled(number, words), pa.array(n, pa.int64())], ["aln_id", "row_idx", "kmer", "n"])

    # '.' is no letter: no k-mer goes across it.
    rows = seqs.groupBy("aln_id", "row_idx").agg(F.array_join(F.collect_list("residues"), ".").alias("residues"))
    return rows.mapInArrow(kernel, f"{_keys(seqs, 'row_idx')}, kmer string, n long")


def _keys(seqs: DataFrame, *rows: str) -> str:
    kind = lambda c: seqs.schema[c].dataType.simpleString()
    return f"aln_id {kind('aln_id')}, " + ", ".join(f"{r} {kind('row_idx')}" for r in rows)


#: Rows of a set that are met by another block of its rows at once.
BLOCK_ROWS = 64


def kmer_distance(seqs: DataFrame, alphabet: str, k: int | None = None) -> DataFrame:
    """aln_id, i, j, d: 1 - shared k-mers / k-mers of the row with fewer; 1 where a row has none.

    Every pair appears, sharing k-mers or not. Residues are dealt by pairs of blocks of rows; a set of up to BLOCK_ROWS rows is
    one, of a larger one each pair of blocks is a task's row of work, as large as the pairs it gives.
    """
    k = k or KMER[alphabet]
    ship_code(seqs.sparkSession)
    block = F.floor(F.col("row_idx") / BLOCK_ROWS)
    rows = seqs.where("aln_id IS NOT NULL AND row_idx IS NOT NULL").select("aln_id", "row_idx", F.coalesce("residues", F.lit("")).alias("residues"), block.alias("_b"))
    blocks = rows.groupBy("aln_id").agg(F.collect_set("_b").alias("_of"))
    dealt = rows.join(blocks, "aln_id").select("aln_id", "row_idx", "residues", "_b", F.explode("_of").alias("_o"))
    dealt = dealt.select("aln_id", "row_idx", "residues", F.greatest("_b", "_o").alias("_i"), F.least("_b", "_o").alias("_j"))

    def kernel(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        row_idx, same = t.column("row_idx").to_numpy(), t.column("_i")[0] == t.column("_j")[0]
        residues = pa.concat_arrays(t.column("residues").chunks)
        found = list(kmers.kmer_counts(residues, k, alphabet))
        row, n = (np.concatenate([np.zeros(0, np.int64), *(f[x] for f in found)]) for x in (0, 2))
        if len(found) < 2 or all(f[3] is found[0][3] for f in found):
            number = np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)])
        else:  # words of several stretches, numbered anew
            number = np.unique(np.concatenate([np.ascontiguousarray(f[3][f[1]]).view(f"S{k}").ravel() for f in found]), return_inverse=True)[1]
        total = np.bincount(row, n, len(row_idx)).astype(np.int64)
        both = kmers.shared(row, number, n, len(row_idx))
        i, j = np.nonzero(row_idx[:, None] > row_idx[None, :])
        if not same:
            other = row_idx // BLOCK_ROWS == t.column("_i")[0].as_py()
            i, j = (x[other[i] & ~other[j]] for x in (i, j))
        least = np.minimum(total[i], total[j])
        share = both[i, j] / np.maximum(least, 1)
        d = np.where(least == 0, 1.0, np.clip(1 - share, 0.0, 1.0))
        ids = t.column("aln_id")
        return pa.table([ids.take(pa.array(i)), pa.array(row_idx[i]), pa.array(row_idx[j]), pa.array(d)], names=["aln_id", "i", "j", "d"])

    return dealt.groupBy("aln_id", "_i", "_j").applyInArrow(kernel, f"{_keys(seqs, 'i', 'j')}, d double")
