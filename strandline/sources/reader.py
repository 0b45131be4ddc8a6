"""Files to DataFrames: each file is read whole by one task and parsed there."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.errors import SeqError
from strandline.session import ship_code

SCHEMA = "aln_id string, row_idx int, id string, description string, residues string, quality array<smallint>, hidden boolean, path string, format string, alphabet string, error string"
_ARROW = pa.schema([("aln_id", pa.string()), ("row_idx", pa.int32()), ("id", pa.string()), ("description", pa.string()), ("residues", pa.string()), ("quality", pa.list_(pa.int16())), ("hidden", pa.bool_()), ("path", pa.string()), ("format", pa.string()), ("alphabet", pa.string()), ("error", pa.string())])


def parse_files(files: DataFrame, format: str | None = None, permissive: bool = False) -> DataFrame:
    """files (path, content) to sequence rows. The format is sniffed, then taken from the extension.

    permissive: a file that can't be parsed gives one row with its error; otherwise the query fails.
    """
    from strandline.sources.parsers import format_of_path, parse, sniff

    def rows(path: str, content: bytes) -> list[dict]:
        stem = path.rstrip("/").rpartition("/")[2].rpartition(".")[0] or path
        base = dict.fromkeys(_ARROW.names) | {"aln_id": stem, "path": path}
        try:
            kind = format or sniff(content) or format_of_path(path) or ""
            got = parse(content, kind)
        except SeqError as e:
            if not permissive:
                raise
            return [base | {"error": str(e)}]
        return [base | {"row_idx": i, "id": r.id, "description": r.description, "residues": r.residues, "quality": r.quality, "hidden": False, "format": got.format, "alphabet": got.alphabet} for i, r in enumerate(got.records)]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):  # one file at a time leaves the batch
                yield pa.RecordBatch.from_pylist(rows(path.as_py(), content.as_py()), schema=_ARROW)

    ship_code(files.sparkSession)
    return files.select("path", "content").mapInArrow(kernel, SCHEMA)


def read_sequences(spark: SparkSession, path: str | list[str], format: str | None = None, permissive: bool = False) -> DataFrame:
    """All sequence files at a path, whatever their formats."""
    return parse_files(spark.read.format("binaryFile").load(path), format, permissive)


def paste_fasta(seqs: DataFrame, fasta: str) -> DataFrame:
    """FASTA records appended to every alignment, after its last row."""
    from strandline.sources.parsers import parse_fasta

    new = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(r.id).alias("id"), F.lit(r.residues).alias("residues")) for i, r in enumerate(parse_fasta(fasta), 1)])
    ends = seqs.groupBy("aln_id").agg(F.max("row_idx").alias("last")).select("aln_id", "last", F.explode(new).alias("r"))
    rows = ends.select("aln_id", (F.col("last") + F.col("r.k")).cast("int").alias("row_idx"), "r.id", "r.residues")
    return seqs.unionByName(rows, allowMissingColumns=True)
