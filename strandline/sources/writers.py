"""Sequence formats as text, assembled natively: aln_id, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.alphabet import NEXUS_TYPE
from strandline.errors import FormatError
from strandline.functions import scalars as S
from strandline.operators.stats import alphabet_guess, cells, shape


def rows_to_write(seqs: DataFrame, include_hidden: bool = False, sanitize: bool = True, uppercase: bool = False) -> DataFrame:
    """Hidden rows left out, names without characters that formats give a meaning to."""
    out = seqs if include_hidden or "hidden" not in seqs.columns else seqs.where(~F.coalesce("hidden", F.lit(False)))
    if sanitize:
        out = out.withColumn("id", F.regexp_replace("id", r"[\s'\"()\[\]:;,]", "_"))
    return out.withColumn("residues", S.upper(F.col("residues"))) if uppercase else out


def wrap(s: Column, width: int) -> Column:
    """Lines of at most so many characters; 0 is one line."""
    if not width:
        return F.when(F.length(s) > 0, F.array(s)).otherwise(F.array().cast("array<string>"))
    lines = F.regexp_extract_all(s, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))  # one pass, however long the row
    return F.when(F.length(s) > 0, lines).otherwise(F.array().cast("array<string>"))


def _joined(rows: DataFrame, line: Column, between: str = "") -> DataFrame:
    """One text for each alignment, from lines in row order."""
    items = F.sort_array(F.collect_list(F.struct("row_idx", line.alias("line"))))
    return rows.groupBy("aln_id").agg(F.array_join(F.transform(items, lambda x: x["line"]), between).alias("text"))


def _in_blocks(rows: DataFrame, label: Column, width: int, later_label: Column | None = None) -> DataFrame:
    """One text for each alignment: all rows' first columns, a blank line, their next columns and so on.

    rows: of equal length. later_label: what lines of the second and later blocks begin with, if not label.
    """
    parts = F.when(F.length("residues") > 0, wrap(F.col("residues"), width)).otherwise(F.array(F.lit("")))
    each = rows.select("aln_id", "row_idx", label.alias("_first"), (label if later_label is None else later_label).alias("_later"), F.posexplode(parts).alias("block", "part"))
    lead = F.when((F.col("block") > 0) & (F.col("row_idx") == F.min("row_idx").over(Window.partitionBy("aln_id", "block"))), "\n").otherwise("")
    line = F.concat(lead, F.when(F.col("block") > 0, F.col("_later")).otherwise(F.col("_first")), "part", F.lit("\n"))
    items = F.sort_array(F.collect_list(F.struct("block", "row_idx", "line")))
    return each.withColumn("line", line).groupBy("aln_id").agg(F.array_join(F.transform(items, lambda x: x["line"]), "").alias("text"))


def require_rectangular(seqs: DataFrame) -> DataFrame:
    """The same rows; the query fails where an alignment's rows differ in length."""
    bad = F.raise_error(F.concat(F.lit("rows of unequal length in "), "aln_id"))
    ok = shape(seqs).where(F.when(F.col("aligned"), F.lit(True)).otherwise(bad.cast("boolean"))).select("aln_id", "width", "rows")
    return seqs.join(ok, "aln_id")


def fasta(seqs: DataFrame, line_width: int = 60) -> DataFrame:
    description = F.col("description") if "description" in seqs.columns else F.lit("")
    line = F.concat(F.lit(">"), S.header(F.col("id"), description), F.lit("\n"), F.array_join(F.transform(wrap(F.col("residues"), line_width), lambda x: F.concat(x, F.lit("\n"))), ""))
    return _joined(seqs, line)


def fastq(seqs: DataFrame) -> DataFrame:
    """Scores plus 33, at most 93; rows without scores get '!'."""
    q = F.coalesce(F.array_join(F.transform("quality", lambda x: F.chr(F.least(x.cast("int"), F.lit(93)) + 33)), ""), F.repeat(F.lit("!"), F.length("residues")))
    description = F.col("description") if "description" in seqs.columns else F.lit("")
    return _joined(seqs, F.concat(F.lit("@"), S.header(F.col("id"), description), F.lit("\n"), "residues", F.lit("\n+\n"), q, F.lit("\n")))


def strict_names(ids: list[str]) -> list[str]:
    """Names of at most ten characters, each once: a taken one ends in 2, 3 and so on."""
    seen: set[str] = set()
    out = []
    for name in ids:
        new, k = name[:10], 1
        while new in seen:
            k += 1
            new = name[: 10 - len(str(k))] + str(k)
        seen.add(new)
        out.append(new)
    return out


def _with_strict_names(seqs: DataFrame) -> DataFrame:
    """The names of an alignment depend on each other in row order: one task takes its names (no residues)."""
    import pandas as pd

    from strandline.session import ship_code

    ship_code(seqs.sparkSession)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx")
        return pdf.assign(id=strict_names(list(pdf["id"])))

    names = seqs.select("aln_id", "row_idx", "id").groupBy("aln_id").applyInPandas(kernel, "aln_id string, row_idx int, id string")
    return seqs.drop("id").join(names, ["aln_id", "row_idx"])


def phylip(seqs: DataFrame, block_width: int = 60, strict: bool = False, interleaved: bool = False) -> DataFrame:
    """Relaxed: names padded to the longest, wrapped rows continue after blanks. Strict: ten-column names.

    interleaved: blocks of all rows; only the first has names.
    """
    r = require_rectangular(_with_strict_names(seqs) if strict else seqs)
    r = r.withColumn("_n", F.lit(10) if strict else F.max(F.length("id")).over(Window.partitionBy("aln_id")) + 1)
    lines = wrap(F.col("residues"), block_width or 60)
    body = F.concat(F.rpad("id", F.col("_n"), F.lit(" ")), F.array_join(F.transform(lines, lambda x, i: F.when(i > 0, F.concat(F.lit("\n"), F.repeat(F.lit(" "), F.col("_n")), x)).otherwise(x)), ""), F.lit("\n"))
    if interleaved:
        out = _in_blocks(r, F.rpad("id", F.col("_n"), F.lit(" ")), block_width or 60, F.lit(""))
    else:
        out = _joined(r.withColumn("_l", body), F.col("_l"))
    return out.join(shape(seqs), "aln_id").select("aln_id", F.concat(F.col("rows").cast("string"), F.lit(" "), F.col("width").cast("string"), F.lit("\n"), "text").alias("text"))


def nexus(seqs: DataFrame, alphabet: str | None = None, interleaved: bool = False, block_width: int = 60) -> DataFrame:
    """alphabet: of all alignments; where none is given, each one's is guessed. interleaved: blocks of all rows."""
    quoted = F.when(F.regexp_like("id", F.lit(r"[\s()\[\]{}/\\,;:=*'\"<>`-]")), F.concat(F.lit("'"), F.replace(F.col("id"), F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(F.col("id"))
    name = F.concat(F.lit("    "), quoted, F.lit(" "))
    r = require_rectangular(seqs)
    body = _in_blocks(r, name, block_width or 60) if interleaved else _joined(r.withColumn("_l", F.concat(name, "residues", F.lit("\n"))), F.col("_l"))
    head = F.concat(F.lit("#NEXUS\n\nbegin data;\n  dimensions ntax="), F.col("rows").cast("string"), F.lit(" nchar="), F.col("width").cast("string"), F.lit(";\n  format datatype="), F.col("_type"), F.lit(f" gap=- missing=?{' interleave=yes' if interleaved else ''};\n  matrix\n"))
    types = F.create_map(*[F.lit(x) for pair in NEXUS_TYPE.items() for x in pair])
    typed = shape(seqs).withColumn("_type", F.lit(NEXUS_TYPE[alphabet])) if alphabet else shape(seqs).join(alphabet_guess(seqs), "aln_id").withColumn("_type", types[F.col("alphabet")])
    return body.join(typed, "aln_id").select("aln_id", F.concat(head, "text", F.lit("  ;\nend;\n")).alias("text"))


def conservation(seqs: DataFrame) -> DataFrame:
    """aln_id, line: '*' under columns in which all rows have one residue, case aside."""
    w = shape(seqs)
    c = cells(seqs).groupBy("aln_id", "col").agg(F.count(F.lit(1)).alias("n"), F.min(S.upper(F.col("res"))).alias("lo"), F.max(S.upper(F.col("res"))).alias("hi"))
    c = c.join(w, "aln_id").select("aln_id", "col", F.when((F.col("n") == F.col("rows")) & (F.col("lo") == F.col("hi")) & ~F.col("lo").isin("-", ".", "~"), "*").otherwise(" ").alias("m"))
    cols = F.sort_array(F.collect_list(F.struct("col", "m")))
    return c.groupBy("aln_id").agg(F.array_join(F.transform(cols, lambda x: x["m"]), "").alias("line"))


def clustal(seqs: DataFrame, block_width: int = 60) -> DataFrame:
    r = require_rectangular(seqs).withColumn("_n", F.greatest(F.max(F.length("id")).over(Window.partitionBy("aln_id")), F.lit(10)) + 6)
    width = block_width or 60
    each = r.select("aln_id", "row_idx", "_n", "id", F.posexplode(wrap(F.col("residues"), width)).alias("block", "part"))
    lines = each.select("aln_id", "block", "row_idx", F.concat(F.rpad("id", F.col("_n"), F.lit(" ")), "part", F.lit("\n")).alias("line"))
    names = r.groupBy("aln_id").agg(F.max("_n").alias("_n"))
    marks = conservation(seqs).join(names, "aln_id").select("aln_id", "_n", F.posexplode(wrap(F.col("line"), width)).alias("block", "part"))
    marks = marks.select("aln_id", "block", F.lit(1 << 30).alias("row_idx"), F.concat(F.repeat(F.lit(" "), F.col("_n")), "part", F.lit("\n\n")).alias("line"))
    items = F.sort_array(F.collect_list(F.struct("block", "row_idx", "line")))
    out = lines.unionByName(marks).groupBy("aln_id").agg(F.array_join(F.transform(items, lambda x: x["line"]), "").alias("text"))
    return out.select("aln_id", F.concat(F.lit("CLUSTAL multiple sequence alignment\n\n\n"), "text").alias("text"))


def stockholm(seqs: DataFrame, interleaved: bool = False, block_width: int = 60) -> DataFrame:
    r = require_rectangular(seqs).withColumn("_n", F.max(F.length("id")).over(Window.partitionBy("aln_id")) + 2)
    name = F.rpad("id", F.col("_n"), F.lit(" "))
    out = _in_blocks(r, name, block_width or 60) if interleaved else _joined(r.withColumn("_l", F.concat(name, "residues", F.lit("\n"))), F.col("_l"))
    return out.select("aln_id", F.concat(F.lit("# STOCKHOLM 1.0\n\n"), "text", F.lit("//\n")).alias("text"))


def render(seqs: DataFrame, format: str, alphabet: str | None = None, crlf: bool = False, **options) -> DataFrame:
    """aln_id, text in a format that can be written; lines end in CR LF if crlf."""
    by = {"fasta": fasta, "fastq": fastq, "phylip-relaxed": phylip, "clustal": clustal, "stockholm": stockholm}
    if format == "nexus":
        out = nexus(seqs, alphabet, **options)
    elif format == "phylip":
        out = phylip(seqs, strict=True, **options)
    elif format in by:
        out = by[format](seqs, **options)
    else:
        raise FormatError(f"can't write {format}")
    return out.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\r\n"))) if crlf else out


def write(seqs: DataFrame, path: str, format: str, **options) -> None:
    """One text row for each alignment in a directory of its own; Spark's commit makes it all or nothing.

    pad=True: rows of unequal length are padded first, as formats of matrices need it. include_hidden, sanitize
    and uppercase are those of rows_to_write(); other options go to the format.
    """
    rows = rows_to_write(seqs, **{k: options.pop(k) for k in ("include_hidden", "sanitize", "uppercase") if k in options})
    if options.pop("pad", False):
        from strandline.operators.edits import pad_rows

        rows = pad_rows(rows)
    render(rows, format, **options).write.partitionBy("aln_id").text(path)
