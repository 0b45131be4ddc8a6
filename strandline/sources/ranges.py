"""Large FASTA and FASTQ files, read in byte ranges by many tasks.

Spark deals a file out in ranges of lines. A task finds the first record that begins in its range and reads on to the
range's end; what stands before that record, and what its last record may still lack, are loose ends. A second pass
joins the ends of neighbouring ranges: a shuffle of at most two pieces a range, or of the ranges that a record longer
than a range covers. Rows are numbered from the counts of the ranges before; what is
broadcast for that has a row or two for each range or file. The result doesn't depend on how files are cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.errors import ParseError
from strandline.functions import scores
from strandline.session import ship_code
from strandline.sources.parsers import _clean, _residues
from strandline.store import Store

#: A piece of a range: k counts from 0 (what stands before its first record). head is null where no record begins; n: the records
#: that begin in the range; lo, hi: the least and greatest mark of its scores; lines of loose ends of FASTQ, whose records are four lines.
PIECE = "path string, start long, k long, head string, residues string, scores string, lo string, hi string, lines array<string>, n long"
_ARROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("k", pa.int64()), ("head", pa.string()), ("residues", pa.string()), ("scores", pa.string()), ("lo", pa.string()), ("hi", pa.string()), ("lines", pa.list_(pa.string())), ("n", pa.int64())])


def _in_ranges(of_range: Callable[[str, int, list[str]], Iterator[dict]]):
    """A kernel over lines in file order: each range of a file goes to of_range as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lines = None, []
        for b in batches:
            for path, start, line in zip(*(b.column(c).to_pylist() for c in ("path", "start", "value")), strict=True):
                if (path, start) != held:
                    if held:
                        yield from _pieces(of_range(*held, lines))
                    held, lines = (path, start), []
                lines.append(line)
        if held:
            yield from _pieces(of_range(*held, lines))

    return run


def _pieces(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    out = []
    for r in rows:
        out.append(r)
        if len(out) == 1000:
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def _fasta_range(path: str, start: int, lines: list[str]) -> Iterator[dict]:
    if start == 0 and lines:
        lines[0] = lines[0].removeprefix("﻿")
    lines = [x for x in (y.strip() for y in lines) if x and not x.startswith(";")]
    at = [i for i, x in enumerate(lines) if x.startswith(">")]
    bounds = [*at, len(lines)]
    body = lambda a, b: _clean(_residues("".join(lines[a:b])))
    base = dict.fromkeys(_ARROW.names) | {"path": path, "start": start, "n": len(at)}
    before = body(0, bounds[0])
    if before and start == 0:
        raise ParseError("FASTA", 1, "sequence data before the first header")
    yield base | {"k": 0, "residues": before}
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False), 1):
        yield base | {"k": k, "head": lines[a][1:], "residues": body(a + 1, b)}


def _begins(lines: list[str]) -> int:
    """Where the first record begins for sure: an '@' two lines before a '+'. A line of scores may begin with '@' too, but two lines
    after it stand residues, which never begin with '+'."""
    return next((i for i in range(len(lines) - 2) if lines[i].startswith("@") and lines[i + 2].startswith("+")), len(lines))


def _fastq_range(path: str, start: int, lines: list[str]) -> Iterator[dict]:
    if start == 0 and lines:
        lines[0] = lines[0].removeprefix("﻿")
    first = _begins(lines)
    n = (len(lines) - first) // 4
    base = dict.fromkeys(_ARROW.names) | {"path": path, "start": start, "n": n}
    anchored = first < len(lines)
    # k = 0: the lines before; k = n + 1: those of a last record that goes on elsewhere.
    yield base | {"k": 0, "lines": lines[:first], "head": None, "residues": None if anchored else ""}
    for k in range(n):
        head, seq, _, qual = lines[first + 4 * k : first + 4 * k + 4]
        yield base | _fastq_record(path, head, seq, qual) | {"k": k + 1}
    if anchored:
        yield base | {"k": n + 1, "lines": lines[first + 4 * n :]}


def _fastq_record(path: str, head: str, seq: str, qual: str) -> dict:
    seq, qual = _clean(_residues(seq)), qual.strip()
    if not head.startswith("@") or len(seq) != len(qual):
        raise ParseError("FASTQ", 1, f"{path}: not a record of four lines at {head[:60]!r}")
    return {"head": head[1:], "residues": seq, "scores": qual, "lo": min(qual, default=None), "hi": max(qual, default=None)}


def _stem(path: Column) -> Column:
    name = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    bare = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.when(name.contains(".") & (bare != ""), bare).otherwise(path)


def _headers(out: DataFrame) -> DataFrame:
    """aln_id, row_idx, id, description, residues, quality, hidden, path, format of rows with head, row_idx and the rest."""
    h = F.regexp_replace(F.col("head"), r"^\s+|\s+$", "")
    words = F.split(h, r"\s+", 2)
    return out.select(
        _stem(F.col("path")).alias("aln_id"), F.col("row_idx").cast("int").alias("row_idx"), words[0].alias("id"), F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("description"),
        "residues", "quality", F.lit(False).alias("hidden"), "path", "format",
    )


#: Ranges that a task reads one after the other, where there are more than a few for each core.
TASK_RANGES = 64


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their file and range. Small ranges share a task, so that tasks follow the bytes, not the size of ranges."""
    ship_code(spark)
    return _fewer(spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value"))


def _fewer(df: DataFrame) -> DataFrame:
    return df.coalesce(max(4 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions() // TASK_RANGES))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The rows that reader.read_sequences() gives for FASTA files, each file read by as many tasks as it has ranges
    (spark.sql.files.maxPartitionBytes). Sequence data before the first header fails the query; a file without a header gives no rows.
    """
    store = Store(spark, "fasta")
    pieces = store.put(_lines(spark, path).mapInArrow(_in_ranges(_fasta_range), PIECE), "pieces")
    ranges = pieces.where("k = 0").select("path", "start", "n")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    ranges = ranges.select("path", "start", before.alias("before"))
    rows = pieces.join(F.broadcast(ranges), ["path", "start"]).withColumn("row_idx", F.col("before") + F.col("k") - 1)
    # Loose ends: what stands before a range's first record, and its last record, which may go on.
    loose = (F.col("k") == 0) | (F.col("k") == F.col("n"))
    ends = rows.where(loose & ((F.col("k") > 0) | (F.col("residues") != ""))).groupBy("path", "row_idx").agg(
        F.max("head").alias("head"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "residues"))), lambda x: x["residues"]), "").alias("residues"))
    orphan = F.raise_error(F.concat(F.lit("FASTA: sequence data before the first header of "), "path"))
    ends = ends.where(F.when(F.col("head").isNotNull(), F.lit(True)).otherwise(orphan.cast("boolean")))
    both = rows.where(~loose).select("path", "row_idx", "head", "residues").unionByName(ends)
    return _headers(both.withColumns({"quality": F.lit(None).cast("array<smallint>"), "format": F.lit("fasta")}))


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As read_fasta(), of FASTQ files whose records are four lines each. Scores count from 64 where a file has none below
    ';' and some above 'J', else from 33. Records of other shapes fail the query: reader.read_sequences() reads them."""
    store = Store(spark, "fastq")
    pieces = store.put(_lines(spark, path).mapInArrow(_in_ranges(_fastq_range), PIECE), "pieces")
    # A range without a sure begin (no residues set to null) belongs to the gap between its neighbours. Gaps are numbered by the ranges with one before.
    ranges = pieces.where("k = 0").select("path", "start", "n", F.col("residues").isNull().cast("long").alias("sure"))
    order = Window.partitionBy("path").orderBy("start")
    ranges = ranges.select("path", "start", (F.sum("sure").over(order) - F.col("sure")).alias("gap"), F.col("n").alias("_n"), "sure")
    ends = _fewer(pieces.where(F.col("lines").isNotNull())).join(F.broadcast(ranges.select("path", "start", "gap", "sure")), ["path", "start"]).withColumn("gap", F.when(F.col("k") > 0, F.col("gap") + F.col("sure")).otherwise(F.col("gap")))
    gaps = ends.groupBy("path", "gap").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("start", "k", "lines"))), lambda x: x["lines"])).alias("lines"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, gap, lines in zip(*(b.column(c).to_pylist() for c in ("path", "gap", "lines")), strict=True):
                lines = list(lines)
                while lines and not lines[-1].strip():  # blank lines at the end of the file
                    lines.pop()
                lines = lines[next((i for i, x in enumerate(lines) if x.strip()), 0) :]
                if len(lines) % 4 == 3:
                    lines.append("")
                if len(lines) % 4:
                    raise ParseError("FASTQ", 1, f"{path}: not records of four lines")
                got = [_fastq_record(path, lines[i], lines[i + 1], lines[i + 3]) for i in range(0, len(lines), 4)]
                yield pa.RecordBatch.from_pylist([r | {"path": path, "gap": gap, "k": k} for k, r in enumerate(got)], schema=pa.schema([("path", pa.string()), ("gap", pa.int64()), ("k", pa.int64()), ("head", pa.string()), ("residues", pa.string()), ("scores", pa.string()), ("lo", pa.string()), ("hi", pa.string())]))

    between = store.put(gaps.mapInArrow(records, "path string, gap long, k long, head string, residues string, scores string, lo string, hi string"), "between")
    # Places in the file: gap 0, the records of the first sure range, gap 1 and so on.
    sizes = between.groupBy("path", "gap").agg(F.count(F.lit(1)).alias("m")).select("path", (2 * F.col("gap")).alias("at"), "m")
    sizes = sizes.unionByName(ranges.where("sure = 1").select("path", (2 * F.col("gap") + 1).alias("at"), F.col("_n").alias("m")))
    begin = sizes.select("path", "at", (F.sum("m").over(Window.partitionBy("path").orderBy("at")) - F.col("m")).alias("begin"))  # two rows for each range
    inside = pieces.where(F.col("head").isNotNull()).join(F.broadcast(ranges.select("path", "start", (2 * F.col("gap") + 1).alias("at"))), ["path", "start"]).select("path", "at", (F.col("k") - 1).alias("k"), "head", "residues", "scores", "lo", "hi")
    every = inside.unionByName(between.select("path", (2 * F.col("gap")).alias("at"), "k", "head", "residues", "scores", "lo", "hi")).join(F.broadcast(begin), ["path", "at"])
    seen = pieces.select("path", "lo", "hi").unionByName(between.select("path", "lo", "hi")).where("lo IS NOT NULL").groupBy("path").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    offset = F.when((F.col("hi") > "J") & (F.col("lo") >= ";"), 64).otherwise(33)
    every = every.join(F.broadcast(seen.select("path", offset.alias("offset"))), "path", "left")
    return _headers(every.withColumns({"row_idx": F.col("begin") + F.col("k"), "quality": scores.scores("scores", "offset"), "format": F.lit("fastq")}))
