"""Row and column edits: each takes and gives a set of sequences. Rows and columns count from 0.

An edit runs on all alignments of a set. A place that one of them doesn't have leaves that one as it is, or,
with strict=True, fails the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.alphabet import GAPS, PROTEIN
from strandline.errors import AlgorithmError, OutOfRangeError
from strandline.functions import scalars as S
from strandline.operators.stats import _all_columns, cells, shape
from strandline.session import ship_code


def _with(seqs: DataFrame, residues: Column, quality: Column | None = None) -> DataFrame:
    out = seqs
    if quality is not None and "quality" in seqs.columns:
        out = out.withColumn("quality", F.when(F.col("quality").isNotNull(), quality))
    return out.withColumn("residues", residues)


def _padded(seqs: DataFrame, least: int = 0) -> DataFrame:
    """Rows padded to the width, which stays as _w."""
    w = shape(seqs).select("aln_id", F.greatest(F.col("width"), F.lit(least)).alias("_w"))
    p = seqs.join(w, "aln_id")
    if "quality" in seqs.columns:
        p = p.withColumn("quality", F.when(F.col("quality").isNotNull(), S.pad_quality(F.col("quality"), F.col("_w"))))
    return p.withColumn("residues", S.pad(F.col("residues"), F.col("_w")))


def _require(df: DataFrame, ok: Column, what: str) -> DataFrame:
    """The same rows; the query fails at the first that isn't ok."""
    bad = F.raise_error(F.concat(F.lit(f"out of range: {what} in "), "aln_id"))
    return df.where(F.when(ok, F.lit(True)).otherwise(bad.cast("boolean")))


def _require_row(seqs: DataFrame, row: int) -> DataFrame:
    rows = shape(seqs).select("aln_id", F.col("rows").alias("_rows"))
    return _require(seqs.join(rows, "aln_id"), F.col("_rows") > row, f"row {row}").select(*seqs.columns)


def pad_rows(seqs: DataFrame) -> DataFrame:
    return _padded(seqs).select(*seqs.columns)


def set_residue(seqs: DataFrame, row: int, col: int, residue: str, strict: bool = False) -> DataFrame:
    """Overwrite one cell; a short row is padded up to it, its scores with 0."""
    if row < 0 or col < 0:
        raise OutOfRangeError("negative row or column")
    seqs = _require_row(seqs, row) if strict else seqs
    r = S.pad(F.col("residues"), F.lit(col + 1))
    new = F.concat(F.substring(r, 1, col), F.lit(residue), F.substring(r, col + 2, 1 << 30))
    here = F.col("row_idx") == row
    q = F.when(here & (F.length("residues") <= col), S.pad_quality(F.col("quality"), F.lit(col + 1))).otherwise(F.col("quality")) if "quality" in seqs.columns else None
    return _with(seqs, F.when(here, new).otherwise(F.col("residues")), q)


def insert_columns(seqs: DataFrame, at: int, count: int, strict: bool = False) -> DataFrame:
    """Gap columns before column `at`; alignments narrower than that stay as they are."""
    if at < 0 or count < 0:
        raise OutOfRangeError("negative column or count")
    p = _padded(seqs)
    p = _require(p, F.col("_w") >= at, f"column {at}") if strict and count else p
    r = F.col("residues")
    new = F.concat(F.substring(r, 1, at), F.lit("-" * count), F.substring(r, at + 1, 1 << 30))
    q = F.concat(F.slice("quality", 1, at), F.array_repeat(F.lit(0).cast("smallint"), count), F.slice("quality", at + 1, 1 << 30)) if "quality" in seqs.columns else None
    q = F.when(F.col("_w") >= at, q).otherwise(F.col("quality")) if q is not None else None
    return _with(p, F.when(F.col("_w") >= at, new).otherwise(r), q).select(*seqs.columns)


def delete_columns(seqs: DataFrame, start: int, end: int, strict: bool = False) -> DataFrame:
    if not 0 <= start <= end:
        raise OutOfRangeError("columns out of order")
    p = _padded(seqs)
    p = _require(p, F.col("_w") >= end, f"column {end}") if strict else p
    r = F.col("residues")
    q = F.concat(F.slice("quality", 1, start), F.slice("quality", end + 1, 1 << 30)) if "quality" in seqs.columns else None
    return _with(p, F.concat(F.substring(r, 1, start), F.substring(r, end + 1, 1 << 30)), q).select(*seqs.columns)


def removed_columns(seqs: DataFrame, start: int, end: int) -> DataFrame:
    """aln_id, row_idx, removed: what delete_columns() takes away, for restore_columns()."""
    if not 0 <= start <= end:
        raise OutOfRangeError("columns out of order")
    return _padded(seqs).select("aln_id", "row_idx", F.substring("residues", start + 1, end - start).alias("removed"))


def restore_columns(seqs: DataFrame, at: int, removed: DataFrame) -> DataFrame:
    """Columns of removed_columns() put back before column `at`; shorter rows are padded up to it, scores come back as 0.

    The query fails where a row has no columns to get back, or the other way round.
    """
    if at < 0:
        raise OutOfRangeError("negative column")
    back = removed.select(F.col("aln_id").alias("_a"), F.col("row_idx").alias("_r"), F.col("removed").alias("_b"))
    both = seqs.join(back, (F.col("aln_id") == F.col("_a")) & (F.col("row_idx") == F.col("_r")), "full")
    bad = F.raise_error(F.concat(F.lit("out of range: rows to restore in "), F.coalesce("aln_id", "_a")))
    both = both.where(F.when(F.col("row_idx").isNotNull() & F.col("_r").isNotNull(), F.lit(True)).otherwise(bad.cast("boolean")))
    r = S.pad(F.col("residues"), F.greatest(F.length("residues"), F.lit(at)))
    q = None
    if "quality" in seqs.columns:
        scores = S.pad_quality(F.col("quality"), F.greatest(F.size("quality"), F.lit(at)))
        q = F.concat(F.slice(scores, 1, at), F.array_repeat(F.lit(0).cast("smallint"), F.length("_b")), F.slice(scores, at + 1, 1 << 30))
    return _with(both, F.concat(F.substring(r, 1, at), "_b", F.substring(r, at + 1, 1 << 30)), q).select(*seqs.columns)


def keep_columns(seqs: DataFrame, mask: DataFrame) -> DataFrame:
    """mask: aln_id, col, keep, one row for each column, else the query fails. Marks travel as one array to the rows."""
    marks = F.transform(F.sort_array(F.collect_list(F.struct("col", F.coalesce("keep", F.lit(False)).alias("keep")))), lambda x: x["keep"])
    kept = mask.groupBy("aln_id").agg(F.count(F.lit(1)).alias("_m"), marks.alias("_keep"))
    p = _require(_padded(seqs).join(kept, "aln_id"), F.col("_m") == F.col("_w"), "size of the mask")
    # Cells and marks side by side: an index into a row from inside a lambda would split the row anew for each cell.
    chosen = lambda values: F.transform(F.filter(F.arrays_zip(values.alias("v"), F.col("_keep").alias("k")), lambda x: x["k"]), lambda x: x["v"])
    q = chosen(F.col("quality")) if "quality" in seqs.columns else None
    return _with(p, F.array_join(chosen(S.cells_of(F.col("residues"))), ""), q).select(*seqs.columns)


def insert_gap(seqs: DataFrame, row: int, col: int, strict: bool = False) -> DataFrame:
    """One gap before column `col` of a row, with score 0. A row that ends before it stays, or is padded if strict."""
    if row < 0 or col < 0:
        raise OutOfRangeError("negative row or column")
    seqs = _require_row(seqs, row) if strict else seqs
    here = F.col("row_idx") == row if strict else (F.col("row_idx") == row) & (F.length("residues") >= col)
    r = S.pad(F.col("residues"), F.greatest(F.length("residues"), F.lit(col)))
    new = F.concat(F.substring(r, 1, col), F.lit("-"), F.substring(r, col + 1, 1 << 30))
    q = None
    if "quality" in seqs.columns:
        scores = S.pad_quality(F.col("quality"), F.greatest(F.size("quality"), F.lit(col)))
        q = F.when(here, F.concat(F.slice(scores, 1, col), F.array(F.lit(0).cast("smallint")), F.slice(scores, col + 1, 1 << 30))).otherwise(F.col("quality"))
    return _with(seqs, F.when(here, new).otherwise(F.col("residues")), q)


def delete_at(seqs: DataFrame, row: int, col: int, strict: bool = False) -> DataFrame:
    """One position of a row goes, with its score; a row that ends before it stays, or fails the query if strict."""
    if row < 0 or col < 0:
        raise OutOfRangeError("negative row or column")
    here = F.col("row_idx") == row
    if strict:
        seqs = _require(_require_row(seqs, row), ~here | (F.length("residues") > col), f"column {col}")
    r = F.col("residues")
    new = F.concat(F.substring(r, 1, col), F.substring(r, col + 2, 1 << 30))
    q = F.when(here, F.concat(F.slice("quality", 1, col), F.slice("quality", col + 2, 1 << 30))).otherwise(F.col("quality")) if "quality" in seqs.columns else None
    return _with(seqs, F.when(here, new).otherwise(r), q)


def all_gap_columns(seqs: DataFrame) -> DataFrame:
    """aln_id, col of columns without any residue."""
    there = cells(seqs).where(~F.col("res").isin(*GAPS)).select("aln_id", "col").distinct()
    return _all_columns(seqs).join(there, ["aln_id", "col"], "left_anti").select("aln_id", "col")


def remove_all_gap_columns(seqs: DataFrame) -> DataFrame:
    there = cells(seqs).where(~F.col("res").isin(*GAPS)).select("aln_id", "col").distinct().withColumn("keep", F.lit(True))
    mask = _all_columns(seqs).join(there, ["aln_id", "col"], "left").select("aln_id", "col", F.coalesce("keep", F.lit(False)).alias("keep"))
    return keep_columns(seqs, mask)


def degap(seqs: DataFrame) -> DataFrame:
    q = None
    if "quality" in seqs.columns:
        q = F.transform(F.filter(F.arrays_zip(S.cells_of(F.col("residues")).alias("r"), F.col("quality").alias("q")), lambda x: ~x["r"].isin(*GAPS)), lambda x: x["q"])
    return _with(seqs, S.ungapped(F.col("residues")), q)


def remove_sequence(seqs: DataFrame, row: int) -> DataFrame:
    return seqs.where(F.col("row_idx") != row).withColumn("row_idx", F.when(F.col("row_idx") > row, F.col("row_idx") - 1).otherwise(F.col("row_idx")))


def insert_sequences(seqs: DataFrame, at: int, new: DataFrame) -> DataFrame:
    """new's rows (numbered from 0) go before row `at`."""
    sizes = new.groupBy("aln_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    moved = seqs.join(sizes, "aln_id", "left").withColumn("row_idx", F.when(F.col("row_idx") >= at, F.col("row_idx") + F.coalesce("_n", F.lit(0))).otherwise(F.col("row_idx"))).select(*seqs.columns)
    return moved.unionByName(new.withColumn("row_idx", F.col("row_idx") + at).select(*seqs.columns))


def move_sequence(seqs: DataFrame, source: int, to: int) -> DataFrame:
    r = F.col("row_idx")
    if source < to:
        new = F.when(r == source, to).when(r.between(source + 1, to), r - 1).otherwise(r)
    else:
        new = F.when(r == source, to).when(r.between(to, source - 1), r + 1).otherwise(r)
    return seqs.withColumn("row_idx", new.cast("int"))


def subset(seqs: DataFrame, rows: list[int], start: int, end: int) -> DataFrame:
    """The listed rows in that order, columns start to end (clipped); rows that aren't there are left out."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(dict.fromkeys(rows)) for x in (r, i)])
    part = seqs.where(F.col("row_idx").isin(*rows)).withColumn("_o", order[F.col("row_idx")])
    n = max(0, end - start)
    q = F.slice("quality", start + 1, n) if "quality" in seqs.columns else None
    return _with(part, F.substring("residues", start + 1, n), q).withColumn("row_idx", F.row_number().over(Window.partitionBy("aln_id").orderBy("_o")) - 1).select(*seqs.columns)


def find_by_id(seqs: DataFrame, id: str) -> DataFrame:
    """aln_id, row_idx of the first row of that id."""
    return seqs.where(F.col("id") == id).groupBy("aln_id").agg(F.min("row_idx").alias("row_idx"))


def renumber(seqs: DataFrame, *order: Column) -> DataFrame:
    return seqs.withColumn("row_idx", (F.row_number().over(Window.partitionBy("aln_id").orderBy(*order, "row_idx")) - 1).cast("int"))


def sort_by_name(seqs: DataFrame) -> DataFrame:
    """Digit runs as numbers, letters without case; equal names keep their order."""
    return renumber(seqs, S.natural_key(F.col("id")))


def sort_by_length(seqs: DataFrame) -> DataFrame:
    return renumber(seqs, F.desc(S.ungapped_length(F.col("residues"))))


def deduplicate_ids(seqs: DataFrame) -> DataFrame:
    """The second and later of equal ids get _2, _3 and so on; names that are taken are passed over.

    A name can only collide with names of its own stem (without such suffixes), so each stem of an
    alignment is one small group.
    """
    ship_code(seqs.sparkSession)
    stem = F.regexp_replace("id", r"(_\d+)+$", "")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, count = None, set(), {}
        for b in batches:
            out = []
            for *group, name in zip(*(b.column(c).to_pylist() for c in ("aln_id", "stem", "id")), strict=True):
                if group != held:
                    held, seen, count = group, set(), {}
                new, n = name, count.get(name, 1)
                while new in seen:
                    n += 1
                    new = f"{name}_{n}"
                count[name] = n
                seen.add(new)
                out.append(new)
            yield pa.RecordBatch.from_arrays([b.column("aln_id"), b.column("row_idx"), pa.array(out, pa.string())], ["aln_id", "row_idx", "new_id"])

    ids = seqs.select("aln_id", "row_idx", "id").withColumn("stem", stem)
    # Groups come one after the other in a task's rows, without a call for each.
    named = ids.repartition("aln_id", "stem").sortWithinPartitions("aln_id", "stem", "row_idx").mapInArrow(kernel, "aln_id string, row_idx int, new_id string")
    return seqs.join(named, ["aln_id", "row_idx"]).withColumn("id", F.col("new_id")).select(*seqs.columns)


def reverse_complement_rows(seqs: DataFrame, rows: list[int], alphabet: str) -> DataFrame:
    """Of nucleotides; proteins have no complement and are refused."""
    if alphabet == PROTEIN:
        raise AlgorithmError("a protein has no reverse complement")
    r = F.col("residues")
    q = F.when(F.col("row_idx").isin(*rows), F.reverse("quality")).otherwise(F.col("quality")) if "quality" in seqs.columns else None
    return _with(seqs, F.when(F.col("row_idx").isin(*rows), S.reverse_complement(r, alphabet)).otherwise(r), q)


def rename(seqs: DataFrame, row: int, header: str) -> DataFrame:
    here = F.col("row_idx") == row
    out = seqs.withColumn("id", F.when(here, S.header_id(F.lit(header))).otherwise(F.col("id")))
    return out.withColumn("description", F.when(here, S.header_description(F.lit(header))).otherwise(F.col("description"))) if "description" in seqs.columns else out


def hide(seqs: DataFrame, rows: list[int], hidden: bool = True) -> DataFrame:
    return seqs.withColumn("hidden", F.when(F.col("row_idx").isin(*rows), hidden).otherwise(F.col("hidden")))


def blank_cells(seqs: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Cells of a rectangle (ends exclusive) become gaps."""
    r = F.col("residues")
    n = F.greatest(F.lit(0), F.least(F.length(r), F.lit(cols[1])) - cols[0]).cast("int")
    new = F.concat(F.substring(r, 1, cols[0]), F.repeat(F.lit("-"), n), F.substring(r, cols[1] + 1, 1 << 30))
    return _with(seqs, F.when((F.col("row_idx") >= rows[0]) & (F.col("row_idx") < rows[1]), new).otherwise(r))
