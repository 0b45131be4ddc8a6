"""Queries of sources, writers and alignment kernels over the sets of strandline.queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.alphabet import PROTEIN
from strandline.functions import views
from strandline.kernels import matrices
from strandline.operators import align, distances, edits, progressive, scores, stats
from strandline.plans.history import History
from strandline.queries import _FAMILY, _KEYS, _STATS, _TEXTS, _sql, family, gapped, query, texts
from strandline.sources import ranges, reader, writers
from strandline.store import Store

_WRAP = "CASE WHEN length(residues) > 0 THEN array_to_string(list_transform(range(0, (length(residues) + 59) // 60), lambda i: substr(residues, i * 60 + 1, 60)), {sep}) ELSE '' END"


@query(_sql(_TEXTS, "SELECT aln_id, string_agg('>' || id || CASE WHEN description <> '' THEN ' ' || description ELSE '' END || chr(10) || CASE WHEN residues <> '' THEN " + _WRAP.format(sep="chr(10)") + " || chr(10) ELSE '' END, '' ORDER BY row_idx) AS text FROM texts GROUP BY aln_id"))
def fasta_write(spark, sf):
    return writers.fasta(texts(spark, sf))


@query(_sql(_TEXTS, "SELECT aln_id, string_agg('@' || id || CASE WHEN description <> '' THEN ' ' || description ELSE '' END || chr(10) || residues || chr(10) || '+' || chr(10) || residues || chr(10), '' ORDER BY row_idx) AS text FROM texts GROUP BY aln_id"))
def fastq_write(spark, sf):
    q = F.transform(F.when(F.length("residues") > 0, F.split("residues", "")).otherwise(F.array().cast("array<string>")), lambda c: (F.ascii(c) - 33).cast("smallint"))
    return writers.fastq(texts(spark, sf).withColumn("quality", q))


_SHAPE = ", sh AS (SELECT aln_id, max(length(residues)) AS w, max(length(id)) AS n FROM family GROUP BY aln_id)"


@query(_sql(_FAMILY + _SHAPE, "SELECT aln_id, '16 ' || max(w) || chr(10) || string_agg(rpad(id, CAST(n + 1 AS INT), ' ') || " + "replace(" + _WRAP.format(sep="chr(10)") + ", chr(10), chr(10) || repeat(' ', n + 1))" + " || chr(10), '' ORDER BY row_idx) AS text FROM family JOIN sh USING (aln_id) GROUP BY aln_id"))
def phylip_write(spark, sf):
    return writers.phylip(family(spark, sf))


@query(_sql(_FAMILY + _SHAPE, "SELECT aln_id, '#NEXUS' || chr(10) || chr(10) || 'begin data;' || chr(10) || '  dimensions ntax=16 nchar=' || max(w) || ';' || chr(10) || '  format datatype=protein gap=- missing=?;' || chr(10) || '  matrix' || chr(10) || string_agg('    ' || id || ' ' || residues || chr(10), '' ORDER BY row_idx) || '  ;' || chr(10) || 'end;' || chr(10) AS text FROM family JOIN sh USING (aln_id) GROUP BY aln_id"))
def nexus_write(spark, sf):
    return writers.nexus(family(spark, sf), PROTEIN)


@query(_sql(_FAMILY + _SHAPE, "SELECT aln_id, '# STOCKHOLM 1.0' || chr(10) || chr(10) || string_agg(rpad(id, CAST(n + 2 AS INT), ' ') || residues || chr(10), '' ORDER BY row_idx) || '//' || chr(10) AS text FROM family JOIN sh USING (aln_id) GROUP BY aln_id"))
def stockholm_write(spark, sf):
    return writers.stockholm(family(spark, sf))


@query(_sql(_FAMILY, "SELECT aln_id, string_agg(CASE WHEN n = 16 AND lo = hi AND lo <> '-' THEN '*' ELSE ' ' END, '' ORDER BY col) AS line FROM (SELECT aln_id, col, count(*) AS n, min(res) AS lo, max(res) AS hi FROM fc GROUP BY ALL) GROUP BY aln_id"))
def clustal_conservation(spark, sf):
    return writers.conservation(family(spark, sf))


def _round_trip(name: str, write, source, ctes: str, table: str, format: str | None) -> None:
    """Text built by a writer and parsed again gives the rows back."""

    def run(spark, sf):
        text = write(source(spark, sf))
        files = text.select(F.concat("aln_id", F.lit(".x")).alias("path"), F.col("text").cast("binary").alias("content"))
        return reader.parse_files(files, format).select("aln_id", "row_idx", "id", "residues")

    query(_sql(ctes, f"SELECT aln_id, CAST(row_number() OVER (PARTITION BY aln_id ORDER BY row_idx) - 1 AS INT) AS row_idx, id, residues FROM {table}"), name)(run)


_round_trip("fasta_parse", writers.fasta, texts, _TEXTS, "texts", None)
_round_trip("fastq_parse", lambda d: writers.fastq(d.withColumn("quality", F.lit(None).cast("array<smallint>"))), texts, _TEXTS, "texts", "fastq")
_round_trip("clustal_parse", writers.clustal, family, _FAMILY, "family", None)
_round_trip("stockholm_parse", writers.stockholm, family, _FAMILY, "family", None)
_round_trip("phylip_parse", writers.phylip, family, _FAMILY, "family", "phylip-relaxed")
_round_trip("nexus_parse", lambda d: writers.nexus(d, PROTEIN), family, _FAMILY, "family", None)


def _ranged(spark, name: str, lines, read):
    """Lines written as text files and read again in ranges of 256 KB, whatever the session has."""
    store, key = Store(spark, name), "spark.sql.files.maxPartitionBytes"
    lines.write.text(f"{store.path}/text")
    had = spark.conf.get(key)
    spark.conf.set(key, str(256 << 10))
    try:
        return read(spark, f"{store.path}/text")
    finally:
        spark.conf.set(key, had)


@query(_sql(_TEXTS, "SELECT id, description, residues FROM texts"))
def fasta_ranges(spark, sf):
    t = texts(spark, sf).withColumn("description", F.coalesce("description", F.lit("")))
    lines = t.select(F.concat(F.lit(">"), "id", F.when(F.col("description") != "", F.concat(F.lit(" "), "description")).otherwise(""), F.lit("\n"), F.array_join(writers.wrap(F.col("residues"), 60), "\n")).alias("value"))
    return _ranged(spark, "fasta-text", lines, ranges.read_fasta).select("id", "description", "residues")


@query(_sql(_TEXTS, "SELECT id, residues, CAST(coalesce(list_sum(list_transform(string_split(residues, ''), lambda x: ascii(x) - 64)), 0) AS BIGINT) AS scores FROM texts WHERE residues <> ''"))
def fastq_ranges(spark, sf):
    """Letters as scores: none is below ';' and some are above 'J', so they count from 64."""
    lines = texts(spark, sf).where("residues <> ''").select(F.concat(F.lit("@"), "id", F.lit("\n"), "residues", F.lit("\n+\n"), "residues").alias("value"))
    back = _ranged(spark, "fastq-text", lines, ranges.read_fastq)
    return back.select("id", "residues", F.aggregate("quality", F.lit(0).cast("long"), lambda s, x: s + x).alias("scores"))


@query(_sql(_TEXTS, "SELECT aln_id, row_idx, replace(residues, '-', '') AS residues FROM gapped"))
def edit_undo_roundtrip(spark, sf):
    """Three edits, two undone, one done again: what stands is the second."""
    h = History(gapped(spark, sf))
    h.apply("insert columns", lambda d: edits.insert_columns(d, 3, 2)).apply("degap", edits.degap).apply("set residue", lambda d: edits.set_residue(d, 0, 0, "?"))
    h.undo()
    h.undo()
    h.redo()
    return h.current.select(*_KEYS)


@query(_sql(_TEXTS, "SELECT aln_id, row_idx, substr(residues, 11, 30) AS residues FROM texts WHERE row_idx >= 2 AND row_idx < 9"))
def viewport(spark, sf):
    return views.viewport(texts(spark, sf), (2, 9), (10, 40)).select(*_KEYS)


@query(_sql(_TEXTS, "SELECT aln_id, row_idx, CASE WHEN length(residues) >= 25 THEN substr(residues, 25, 1) ELSE '-' END AS res FROM texts"))
def column_at(spark, sf):
    return views.column_at(texts(spark, sf), 25)


@query(
    _sql(
        _FAMILY + "," + _STATS,
        """, con AS (SELECT aln_id, col, CASE WHEN occupancy = 0 OR CAST(occupancy AS FLOAT) / 16 < CAST(0.05 AS FLOAT) THEN '-' WHEN majority IS NOT NULL AND CAST(majority_count AS FLOAT) / CAST(occupancy AS FLOAT) >= CAST(0.5 AS FLOAT) THEN majority ELSE 'X' END AS c FROM cs)
SELECT aln_id, row_idx, string_agg(CASE WHEN res = c AND res <> '-' THEN '.' ELSE res END, '' ORDER BY col) AS residues FROM fc JOIN con USING (aln_id, col) GROUP BY ALL""",
    )
)
def dots_view(spark, sf):
    f = family(spark, sf)
    return views.dots(f, stats.consensus(f, PROTEIN)).select(*_KEYS)


@query(_sql(_FAMILY + "," + _STATS, "SELECT aln_id, col, CASE WHEN q > CAST(0.9 AS FLOAT) THEN 'high' WHEN q > CAST(0.6 AS FLOAT) THEN 'middle' ELSE 'low' END AS class FROM (SELECT aln_id, col, CASE WHEN occupancy = 0 THEN CAST(0 AS FLOAT) ELSE CAST(occupancy AS FLOAT) / 16 * (CAST(majority_count AS FLOAT) / CAST(occupancy AS FLOAT)) END AS q FROM cs)"))
def quality_track(spark, sf):
    from strandline.functions import scalars as S

    s = stats.with_fractions(stats.column_stats(family(spark, sf), PROTEIN))
    return s.select("aln_id", "col", S.quality_class(F.col("quality").cast("float")).alias("class"))


# Alignment. The rows as they came show how `family` was made: deletions alone move residues, so they are the true
# alignment. Set left-aligned without gaps, rows of no family share over 0.42 of its residue pairs.


_HELD = _sql(_FAMILY, "SELECT aln_id, row_idx, replace(residues, '-', '') AS residues, true AS even, true AS aligned FROM family")


def _held(spark, sf, aligned, least: float):
    """Rows without gaps, whether all rows of the set have one width, and whether at least that share of the true pairs is found."""
    aligned = Store(spark, "held").put(aligned.select(*_KEYS), "aligned")
    found = stats.accuracy(aligned, family(spark, sf)).select("aln_id", (F.col("sp") >= least).alias("aligned"))
    even = stats.shape(aligned).select("aln_id", F.col("aligned").alias("even"))
    return edits.degap(aligned).select(*_KEYS).join(even, "aln_id").join(found, "aln_id")


@query(_HELD)
def align_muscle(spark, sf):
    return _held(spark, sf, align.align(family(spark, sf), PROTEIN, "muscle"), 0.65)


@query(_HELD)
def align_clustal(spark, sf):
    return _held(spark, sf, align.align(family(spark, sf), PROTEIN, "clustal"), 0.65)


@query(_HELD)
def align_mafft(spark, sf):
    return _held(spark, sf, align.align(family(spark, sf), PROTEIN, "mafft"), 0.65)


@query(_HELD)
def align_levels(spark, sf):
    return _held(spark, sf, progressive.align_levels(family(spark, sf), PROTEIN), 0.65)


def _sum_of_pairs_sql() -> str:
    """All pairs of rows, cell by cell."""
    m = matrices.choose(PROTEIN)
    table = ", ".join(f"('{chr(a)}', '{chr(b)}', {float(m.table[a, b])})" for a in range(65, 91) for b in range(65, 91))
    scale = m.mean_diagonal / 5.8
    return _sql(_FAMILY, f""", t(x, y, s) AS (VALUES {table}),
g AS (SELECT *, coalesce(lag(res) OVER (PARTITION BY aln_id, row_idx ORDER BY col), res) = '-' AS after, count(*) FILTER (res <> '-') OVER (PARTITION BY aln_id, row_idx ORDER BY col) AS filled, count(*) FILTER (res <> '-') OVER (PARTITION BY aln_id, row_idx) AS every FROM fc),
p AS (SELECT a.aln_id, a.res AS x, b.res AS y, CASE WHEN a.res = '-' THEN a.after ELSE b.after END AS gap_after, CASE WHEN a.res = '-' THEN b.after ELSE a.after END AS other_after,
  CASE WHEN a.res = '-' THEN a.filled = 0 OR a.filled = a.every ELSE b.filled = 0 OR b.filled = b.every END AS terminal FROM g a JOIN g b ON a.aln_id = b.aln_id AND a.col = b.col AND a.row_idx > b.row_idx)
SELECT aln_id, round(sum(CAST(CASE WHEN p.x <> '-' AND p.y <> '-' THEN s ELSE 0 END AS DOUBLE)), 4) AS pairs,
  round(sum(CAST(CASE WHEN (p.x = '-') <> (p.y = '-') THEN CAST({scale} AS DOUBLE) * CASE WHEN terminal THEN 0.5 ELSE 1 END * (1.0 + CASE WHEN gap_after AND NOT other_after THEN 0 ELSE 5.0 END) ELSE 0 END AS DOUBLE)), 4) AS gaps
FROM p LEFT JOIN t ON p.x = t.x AND p.y = t.y GROUP BY aln_id""")


@query(_sum_of_pairs_sql())
def sum_of_pairs(spark, sf):
    s = scores.sum_of_pairs(family(spark, sf), PROTEIN)
    return s.select("aln_id", F.round("pairs", 4).alias("pairs"), F.round("gaps", 4).alias("gaps"))


@query()
def upgma_rounds(spark, sf):
    f = family(spark, sf)
    tree, _ = progressive.guide_rounds(distances.corrected(f, PROTEIN), f, Store(spark, "rounds"))
    return tree.withColumn("height", F.round("height", 6))


@query(_sql(_FAMILY, "SELECT aln_id, row_idx, substr(residues, 1, 20) || '|' || replace(substr(residues, 21, 20), '-', '') || '|' || substr(residues, 41) AS parts FROM family"))
def realign_region(spark, sf):
    new = align.realign_region(family(spark, sf), 20, 40, PROTEIN)
    old = family(spark, sf).select("aln_id", "row_idx", (F.length("residues") - 40).alias("tail"))
    tail = F.when(F.col("tail") > 0, F.substring("residues", F.length("residues") - F.col("tail") + 1, F.col("tail"))).otherwise("")
    n = F.length("residues") - F.greatest("tail", F.lit(0)) - 20
    middle = F.translate(F.substring(F.col("residues"), F.lit(21), n), "-", "")
    return new.join(old, ["aln_id", "row_idx"]).select("aln_id", "row_idx", F.concat(F.substring("residues", 1, 20), F.lit("|"), middle, F.lit("|"), tail).alias("parts"))


@query(_HELD)
def add_to_alignment(spark, sf):
    f = family(spark, sf)
    base, more = f.where("row_idx < 12"), f.where("row_idx >= 12").withColumn("row_idx", F.col("row_idx") - 12)
    return _held(spark, sf, align.add_to_alignment(base, more, PROTEIN), 0.65)


@query()
def nj_tree(spark, sf):
    f = family(spark, sf)
    return align.guide_trees(distances.corrected(f, PROTEIN), f, "nj")


@query()
def upgma_tree(spark, sf):
    f = family(spark, sf)
    return align.guide_trees(distances.corrected(f, PROTEIN), f, "upgma")


@query(_sql(_FAMILY, "SELECT a.aln_id, a.row_idx AS i, b.row_idx AS j, replace(a.residues, '-', '') AS a, replace(b.residues, '-', '') AS b, true AS aligned FROM family a JOIN family b USING (aln_id) WHERE a.row_idx > b.row_idx"))
def pairwise_global(spark, sf):
    p = align.pairwise_align(family(spark, sf), PROTEIN)
    same = lambda a, b: F.size(F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda z: (z["x"] == z["y"]) & (z["x"] != "-")))
    true = stats.pairs(family(spark, sf)).select("aln_id", "i", "j", same(F.col("a"), F.col("b")).alias("true_same"))
    # The best alignment by score has about as many equal residues as the true one; rows that aren't aligned have a fraction.
    found = same(F.col("row_i"), F.col("row_j")) >= 0.8 * F.col("true_same")
    return p.join(true, ["aln_id", "i", "j"]).select("aln_id", "i", "j", F.translate("row_i", "-", "").alias("a"), F.translate("row_j", "-", "").alias("b"), found.alias("aligned"))


@query(_sql(_FAMILY, """, n AS (SELECT aln_id, col, count(*) FILTER (res <> '-' AND row_idx % 2 = 0) AS e, count(*) FILTER (res <> '-' AND row_idx % 2 = 1) AS o FROM fc GROUP BY ALL)
SELECT aln_id, round(sum(e * (e - 1) / 2 + o * (o - 1) / 2) / sum((e + o) * (e + o - 1) / 2), 6) AS sp, round(count(*) FILTER (e + o > 1 AND (e = 0 OR o = 0)) / count(*) FILTER (e + o > 1), 6) AS tc FROM n GROUP BY aln_id"""))
def accuracy_shifted(spark, sf):
    """Every other row is moved by one column, so that half the pairs and nearly all columns are lost."""
    f = family(spark, sf)
    moved = f.withColumn("residues", F.when(F.col("row_idx") % 2 == 1, F.concat(F.lit("-"), "residues")).otherwise(F.col("residues")))
    return stats.accuracy(moved, f).select("aln_id", F.round("sp", 6).alias("sp"), F.round("tc", 6).alias("tc"))


@query()
def pairwise_distance(spark, sf):
    return align.pairwise_distance(family(spark, sf), PROTEIN)


@query()
def pairwise_local(spark, sf):
    return align.pairwise_align(family(spark, sf), PROTEIN, "local")


@query()
def accuracy_clustal(spark, sf):
    f = family(spark, sf)
    return stats.accuracy(align.align(f, PROTEIN, "clustal"), f)
