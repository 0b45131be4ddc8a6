"""Column and row filters, and conserved-block selection by windows over runs of columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.alphabet import BLANKS, PROTEIN, SIMILAR
from strandline.errors import AlgorithmError
from strandline.functions import scalars as S
from strandline.operators.edits import keep_columns
from strandline.operators.stats import _all_columns, as_float, cells, shape

NONE, HALF, ALL = "none", "half", "all"
HIGH, CONSERVED, NONCONSERVED, GAPPY = "HighlyConserved", "Conserved", "NonConserved", "GapRich"


def _blank_counts(seqs: DataFrame) -> DataFrame:
    """aln_id, col, rows, blank: gaps and missing marks, those beyond a row's end included."""
    there = cells(seqs).where(~F.col("res").isin(*BLANKS)).groupBy("aln_id", "col").agg(F.count(F.lit(1)).alias("n"))
    return _all_columns(seqs).join(there, ["aln_id", "col"], "left").select("aln_id", "col", "rows", (F.col("rows") - F.coalesce("n", F.lit(0))).alias("blank"))


def gappy_columns(seqs: DataFrame, limit: float) -> DataFrame:
    """aln_id, col, keep: at most this share of the column is blank (in single precision)."""
    return _blank_counts(seqs).select("aln_id", "col", (as_float(F.col("blank"), F.col("rows")) <= F.lit(min(1.0, max(0.0, limit))).cast("float")).alias("keep"))


def gappy_sequences(seqs: DataFrame, limit: float) -> DataFrame:
    """aln_id, row_idx, keep: at most this share of the full width is blank; an empty alignment keeps all."""
    w = shape(seqs).select("aln_id", "width")
    filled = F.length(S.without(F.col("residues"), BLANKS))
    return seqs.join(w, "aln_id").select("aln_id", "row_idx", ((F.col("width") == 0) | (as_float(F.col("width") - filled, F.col("width")) <= F.lit(min(1.0, max(0.0, limit))).cast("float"))).alias("keep"))


def trim_ends(seqs: DataFrame, min_occupancy: float) -> DataFrame:
    """aln_id, start, end: from the first to the last column that is occupied enough; 0, 0 where none is."""
    ok = _blank_counts(seqs).withColumn("ok", as_float(F.col("rows") - F.col("blank"), F.col("rows")) >= F.lit(min_occupancy).cast("float"))
    ends = ok.groupBy("aln_id").agg(F.min(F.when(F.col("ok"), F.col("col"))).alias("start"), F.max(F.when(F.col("ok"), F.col("col"))).alias("end"))
    return ends.select("aln_id", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce(F.col("end") + 1, F.lit(0)).alias("end"))


PRESET = 0.5  # of the two presets below


def without_gappy_columns(seqs: DataFrame) -> DataFrame:
    """Columns go that are blank in more than half of the rows."""
    return keep_columns(seqs, gappy_columns(seqs, PRESET))


def with_trimmed_ends(seqs: DataFrame) -> DataFrame:
    """Columns go before the first and after the last that at least half of the rows fill."""
    ends = trim_ends(seqs, PRESET)
    mask = _all_columns(seqs).join(ends, "aln_id").select("aln_id", "col", ((F.col("col") >= F.col("start")) & (F.col("col") < F.col("end"))).alias("keep"))
    return keep_columns(seqs, mask)


@dataclass(frozen=True)
class Blocks:
    """Parameters; b1 and b2 as shares of the rows are worked out for each alignment where they are None."""

    b1: int | None = None
    b2: int | None = None
    b3: int = 8
    b4: int = 10
    b5: str = NONE
    similarity: bool = True

    @classmethod
    def relaxed(cls) -> Blocks:
        return cls(b2=-1, b4=5, b5=HALF)

    def validate(self, rows: int) -> None:
        b1 = rows // 2 + 1 if self.b1 is None else self.b1
        b2 = max((17 * rows + 19) // 20, b1) if self.b2 is None else b1 if self.b2 < 0 else self.b2
        if rows < 1:
            raise AlgorithmError("no rows")
        if not rows / 2 < b1 <= rows:
            raise AlgorithmError(f"b1 must be over half of {rows} rows and at most all, not {b1}")
        if not b1 <= b2 <= rows:
            raise AlgorithmError(f"b2 must be from b1 to {rows}, not {b2}")
        self.validate_sizes()

    def validate_sizes(self) -> None:
        """What doesn't depend on the number of rows."""
        if self.b3 < 1 or self.b4 < 2 or self.b5 not in (NONE, HALF, ALL):
            raise AlgorithmError("b3 must be at least 1, b4 at least 2, and b5 none, half or all")


def block_flags(seqs: DataFrame, alphabet: str, p: Blocks = Blocks()) -> DataFrame:
    """aln_id, col, flag. The most common letter decides (ties: the lowest byte); blanks are gaps and '?'."""
    p.validate_sizes()
    u = S.upper(F.col("res"))
    letters = cells(seqs).where(~F.col("res").isin(*BLANKS)).groupBy("aln_id", "col", u.alias("res")).agg(F.count(F.lit(1)).alias("n"))
    rank = Window.partitionBy("aln_id", "col")
    best = letters.withColumns({"top": F.max(F.struct("n", (-F.ascii("res")).alias("o"))).over(rank), "filled": F.sum("n").over(rank)})
    top = F.chr(-F.col("top.o"))
    if alphabet == PROTEIN and p.similarity:
        sets = F.create_map(*[F.lit(x) for k, v in SIMILAR.items() for x in (k, v)])
        similar = F.coalesce(F.contains(F.try_element_at(sets, top), F.col("res")), F.col("res") == top)
    else:
        similar = F.col("res") == top
    tally = best.groupBy("aln_id", "col").agg(F.max("top.n").alias("identities"), F.sum(F.when(similar, F.col("n")).otherwise(0)).alias("similarities"), F.max("filled").alias("filled"))
    full = _all_columns(seqs).join(tally, ["aln_id", "col"], "left").fillna(0, ["identities", "similarities", "filled"])
    rows, gaps = F.col("rows"), F.col("rows") - F.col("filled")
    b1 = F.floor(rows / 2) + 1 if p.b1 is None else F.lit(p.b1)
    b2 = F.greatest(F.floor((17 * rows + 19) / 20), b1) if p.b2 is None else b1 if p.b2 < 0 else F.lit(p.b2)
    bad = F.raise_error(F.concat(F.lit(f"b1 {p.b1} and b2 {p.b2} don't suit the rows of "), "aln_id"))
    full = full.where(F.when((b1 * 2 > rows) & (b1 <= b2) & (b2 <= rows), F.lit(True)).otherwise(bad.cast("boolean")))
    allowed = {NONE: gaps == 0, HALF: gaps * 2 < rows, ALL: F.lit(True)}[p.b5]
    flank = F.when(F.col("identities") * 2 > rows, F.col("similarities")).otherwise(F.col("identities"))
    return full.select("aln_id", "col", F.when(~allowed, GAPPY).when(flank >= b2, HIGH).when(F.col("identities") >= b1, CONSERVED).otherwise(NONCONSERVED).alias("flag"))


def with_runs(df: DataFrame, value, name: str) -> DataFrame:
    """df plus the number of the maximal run of equal values that a column lies in."""
    order = Window.partitionBy("aln_id").orderBy("col")
    before = F.lag(value).over(order)
    step = F.when(before.isNull() | (before != value), 1).otherwise(0)
    return df.withColumn("_step", step).withColumn(name, F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def block_mask(seqs: DataFrame, alphabet: str, p: Blocks = Blocks()) -> DataFrame:
    """aln_id, col, flag, keep. All windows share one exchange by alignment; it has one row for each column."""
    flags = block_flags(seqs, alphabet, p).withColumn("_bad", F.col("flag").isin(NONCONSERVED, GAPPY))
    r = with_runs(flags, F.col("_bad"), "_run")
    run = Window.partitionBy("aln_id", "_run")
    r = r.withColumns({"_len": F.count(F.lit(1)).over(run), "_gappy": F.max(F.col("flag") == GAPPY).over(run)})
    r = with_runs(r.withColumn("_sel", ~(F.col("_bad") & (F.col("_len") > p.b3))), F.col("_sel"), "_part")
    part = Window.partitionBy("aln_id", "_part")
    high = F.when(F.col("flag") == HIGH, F.col("col"))
    inside = F.col("_sel") & (F.col("col") >= F.min(high).over(part)) & (F.col("col") <= F.max(high).over(part))
    kept = F.coalesce(inside, F.lit(False))
    if p.b5 != ALL:
        kept = kept & ~(F.col("_bad") & F.col("_gappy"))
    r = with_runs(r.withColumn("_sel", kept), F.col("_sel"), "_block")
    size = F.count(F.lit(1)).over(Window.partitionBy("aln_id", "_block"))
    return r.select("aln_id", "col", "flag", (F.col("_sel") & (size >= p.b4)).alias("keep"))


def blocks(mask: DataFrame) -> DataFrame:
    """aln_id, start, end (exclusive) of the kept runs."""
    r = with_runs(mask, F.col("keep"), "_run").where("keep")
    return r.groupBy("aln_id", "_run").agg(F.min("col").alias("start"), (F.max("col") + 1).alias("end")).drop("_run")


def mask_line(mask: DataFrame) -> DataFrame:
    """aln_id, line: '#' for kept columns, a blank for others."""
    cols = F.sort_array(F.collect_list(F.struct("col", F.when(F.col("keep"), "#").otherwise(" ").alias("c"))))
    return mask.groupBy("aln_id").agg(F.array_join(F.transform(cols, lambda x: x["c"]), "").alias("line"), F.count_if("keep").alias("kept"), F.count(F.lit(1)).alias("total"))
