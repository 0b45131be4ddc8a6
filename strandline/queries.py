"""Queries over the driver tables, and the SQL that gives the same rows.

No table holds biological sequences, so two sets are derived, alike in Spark and in SQL, from whole tables:

* `texts`: the letters of each document in upper case, sixteen documents to an alignment; unrelated rows
  of very different lengths.
* `family`: sixteen rows for each benchmark text, its letters changed by integer arithmetic over (alignment,
  row, column): every third stretch of twenty columns is ragged, the others are mostly alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.alphabet import DNA, PROTEIN
from strandline.functions import scalars as S
from strandline.functions import scores
from strandline.operators import clean, distances, edits, stats
from strandline.session import ship_code

LETTERS, AS_DNA = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").where("doc_id is not null")
    r = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", ""))
    return d.select(F.floor(F.col("doc_id") / 16).cast("string").alias("aln_id"), (F.col("doc_id") % 16).cast("int").alias("row_idx"), F.concat(F.lit("seq"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("description"), r.alias("residues"))


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).withColumn("residues", F.translate("residues", LETTERS, AS_DNA))


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).withColumn("residues", F.translate("residues", "EQ", "-?"))


def family(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _table(spark, sf_dir, "benchmark").where("item_id is not null").select(F.col("item_id").alias("a"), F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", "")).alias("base"))
    rows = b.where(F.length("base") > 0).select("a", "base", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("r"))
    a, r = F.col("a"), F.col("r").cast("long")

    def cell(c):
        c = c.cast("long")
        u = (((a * 31 + r * 7919 + c * 104729 + r * c * 613) % 1009) * 37 + r * 11) % 100
        v = (a * 17 + r * 13 + c * 7) % 26
        ragged = F.floor(c / 20) % 3 == 1
        return F.when((ragged & (u < 12)) | (~ragged & (u < 1)), "-").when((ragged & (u < 85)) | (~ragged & (u < 8)), F.chr(v + 65)).otherwise(F.substring("base", (c + 1).cast("int"), F.lit(1)))

    res = F.array_join(F.transform(F.sequence(F.lit(0), F.length("base") - 1), cell), "")
    return rows.select(a.cast("string").alias("aln_id"), F.col("r").cast("int").alias("row_idx"), F.concat(F.lit("t"), F.col("r").cast("string")).alias("id"), res.alias("residues"))


_TEXTS = f"""
texts AS (SELECT CAST(doc_id // 16 AS VARCHAR) AS aln_id, CAST(doc_id % 16 AS INT) AS row_idx, 'seq' || doc_id AS id, source AS description,
  upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS residues FROM documents WHERE doc_id IS NOT NULL),
dna AS (SELECT aln_id, row_idx, id, description, translate(residues, '{LETTERS}', '{AS_DNA}') AS residues FROM texts),
gapped AS (SELECT aln_id, row_idx, id, description, translate(residues, 'EQ', '-?') AS residues FROM texts)"""
_FAMILY = """
base AS (SELECT item_id AS a, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS base FROM benchmark WHERE item_id IS NOT NULL),
fcell AS (SELECT a, r, c, CASE WHEN (reg = 1 AND u < 12) OR (reg <> 1 AND u < 1) THEN '-' WHEN (reg = 1 AND u < 85) OR (reg <> 1 AND u < 8) THEN chr(CAST(v + 65 AS INT)) ELSE substr(base, c + 1, 1) END AS res
  FROM (SELECT a, r, c, base, (((a * 31 + r * 7919 + c * 104729 + r * c * 613) % 1009) * 37 + r * 11) % 100 AS u, (a * 17 + r * 13 + c * 7) % 26 AS v, (c // 20) % 3 AS reg
    FROM (SELECT a, base, r, unnest(range(0, length(base))) AS c FROM (SELECT a, base, unnest(range(0, 16)) AS r FROM base WHERE length(base) > 0)))),
family AS (SELECT CAST(a AS VARCHAR) AS aln_id, CAST(r AS INT) AS row_idx, 't' || r AS id, string_agg(res, '' ORDER BY c) AS residues FROM fcell GROUP BY a, r),
fc AS (SELECT CAST(a AS VARCHAR) AS aln_id, CAST(r AS INT) AS row_idx, CAST(c AS INT) AS col, res FROM fcell)"""


def _sql(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}{body if body.lstrip().startswith(',') else chr(10) + body}"


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        _QUERIES[name or f.__name__] = f
        if sql:
            _ORACLES[name or f.__name__] = sql
        return f

    return add


# Scalars


@query(_sql(_TEXTS, "SELECT aln_id, row_idx, CAST(length(residues) AS BIGINT) AS n, CAST(length(translate(residues, '-.~', '')) AS BIGINT) AS ungapped FROM gapped"))
def seq_lengths(spark, sf):
    return gapped(spark, sf).select("aln_id", "row_idx", F.length("residues").cast("long").alias("n"), S.ungapped_length(F.col("residues")).cast("long").alias("ungapped"))


@query(_sql(_TEXTS, "SELECT aln_id, row_idx, translate(residues, '-', '') AS residues FROM gapped"))
def seq_ungapped(spark, sf):
    return gapped(spark, sf).select("aln_id", "row_idx", S.ungapped(F.col("residues")).alias("residues"))


@query(_sql(_TEXTS, "SELECT aln_id, row_idx, id || ' ' || description AS header, id AS back_id, description AS back_description FROM texts WHERE description <> ''"))
def seq_headers(spark, sf):
    h = texts(spark, sf).where("description <> ''").withColumn("header", S.header(F.col("id"), F.col("description")))
    return h.select("aln_id", "row_idx", "header", S.header_id(F.col("header")).alias("back_id"), S.header_description(F.col("header")).alias("back_description"))


@query(_sql(_TEXTS, "SELECT aln_id, row_idx, reverse(translate(residues, 'ACGT', 'TGCA')) AS residues FROM dna"))
def reverse_complement(spark, sf):
    return dna(spark, sf).select("aln_id", "row_idx", S.reverse_complement(F.col("residues"), DNA).alias("residues"))


@query(_sql(_TEXTS, "SELECT aln_id, row_idx, CASE WHEN length(residues) > 10 AND substr(residues, 11, 1) <> '-' THEN CAST(length(replace(substr(residues, 1, 10), '-', '')) AS INT) ELSE -1 END AS idx FROM gapped"))
def residue_index(spark, sf):
    return gapped(spark, sf).select("aln_id", "row_idx", F.coalesce(S.residue_index(F.col("residues"), F.lit(10)), F.lit(-1)).alias("idx"))


@query(_sql(_TEXTS, "SELECT aln_id, row_idx, CASE WHEN length(translate(residues, '-', '')) > 0 THEN round(list_sum(list_transform(string_split(translate(residues, '-', ''), ''), lambda x: ascii(x) - 33)) / length(translate(residues, '-', '')), 6) END AS q FROM gapped"))
def quality_mean(spark, sf):
    rows = gapped(ship_code(spark), sf)  # before the functions, which keep the workers' paths as they find them
    quality = scores.scores("residues", F.lit(33))
    return rows.select("aln_id", "row_idx", F.round(scores.mean_quality("residues", quality), 6).alias("q"))


@query(_sql(_TEXTS, "SELECT aln_id, row_idx, round(coalesce(length(translate(residues, '-ACDEFGHIKLMNPQRSTVWY', '')) / nullif(length(replace(residues, '-', '')), 0), 0), 6) AS f FROM gapped"))
def ambiguity_fraction(spark, sf):
    return gapped(spark, sf).select("aln_id", "row_idx", F.round(S.ambiguity_fraction(F.col("residues"), PROTEIN), 6).alias("f"))


@query(_sql(_TEXTS, "SELECT res, CAST(count(*) AS BIGINT) AS n, strpos('ACGTRYSWKMBDHVN-?', res) > 0 AS valid, strpos('ACGTU', res) = 0 AS ambiguous FROM (SELECT unnest(string_split(residues, '')) AS res FROM gapped WHERE residues <> '') GROUP BY res"))
def valid_residues(spark, sf):
    n = stats.cells(gapped(spark, sf)).groupBy("res").agg(F.count(F.lit(1)).alias("n"))
    return n.select("res", "n", S.is_valid(F.col("res"), DNA).alias("valid"), S.is_ambiguous(F.col("res"), DNA).alias("ambiguous"))


_GUESS = """
SELECT aln_id, CASE WHEN (n = 0 OR nuc / n >= 0.85) AND u > t THEN 'RNA' WHEN n = 0 OR nuc / n >= 0.85 THEN 'DNA' ELSE 'protein' END AS alphabet
FROM (SELECT aln_id, sum(length(r)) AS n, sum(length(r) - length(translate(r, 'ACGTUN', ''))) AS nuc, sum(length(r) - length(replace(r, 'U', ''))) AS u, sum(length(r) - length(replace(r, 'T', ''))) AS t
  FROM (SELECT aln_id, regexp_replace(substr(residues, 1, 5000), '[-?]', '', 'g') AS r FROM {t}) GROUP BY aln_id)"""
query(_sql(_TEXTS, _GUESS.format(t="gapped")), "alphabet_guess")(lambda spark, sf: stats.alphabet_guess(gapped(spark, sf)))
query(_sql(_TEXTS, _GUESS.format(t="dna")), "alphabet_guess_dna")(lambda spark, sf: stats.alphabet_guess(dna(spark, sf)))


@query(_sql(_TEXTS, "SELECT aln_id, row_idx, res, CAST(count(*) AS BIGINT) AS n, CASE res WHEN '-' THEN 'gap' WHEN '?' THEN 'gap' WHEN 'A' THEN 'A' WHEN 'C' THEN 'C' WHEN 'G' THEN 'G' WHEN 'T' THEN 'T' WHEN 'U' THEN 'T' ELSE 'other' END AS class FROM (SELECT aln_id, row_idx, unnest(string_split(residues, '')) AS res FROM gapped WHERE residues <> '') GROUP BY ALL"))
def residue_classes(spark, sf):
    n = stats.cells(gapped(spark, sf)).groupBy("aln_id", "row_idx", "res").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("class", S.residue_class(F.col("res"), DNA))


# Edits

_PAD = "padded AS (SELECT *, rpad(residues, CAST(max(length(residues)) OVER (PARTITION BY aln_id) AS INT), '-') AS p, max(length(residues)) OVER (PARTITION BY aln_id) AS w FROM gapped)"
_KEYS = ("aln_id", "row_idx", "residues")


def _edit(name: str, expr: str, f: Callable[[DataFrame], DataFrame], where: str = "") -> None:
    query(_sql(_TEXTS + ",\n" + _PAD, f"SELECT aln_id, row_idx, {expr} AS residues FROM padded {where}"), name)(lambda spark, sf: f(gapped(spark, sf)).select(*_KEYS))


_edit("pad_rows", "p", edits.pad_rows)
_edit("insert_columns", "CASE WHEN w >= 7 THEN substr(p, 1, 7) || '---' || substr(p, 8) ELSE p END", lambda d: edits.insert_columns(d, 7, 3))
_edit("delete_columns", "substr(p, 1, 5) || substr(p, 10)", lambda d: edits.delete_columns(d, 5, 9))
_edit("degap", "replace(residues, '-', '')", edits.degap)
_edit("set_residue", "CASE WHEN row_idx = 2 THEN substr(rpad(residues, greatest(CAST(length(residues) AS INT), 31), '-'), 1, 30) || 'W' || substr(residues, 32) ELSE residues END", lambda d: edits.set_residue(d, 2, 30, "W"))
_edit("insert_gap", "CASE WHEN row_idx = 1 AND length(residues) >= 4 THEN substr(residues, 1, 4) || '-' || substr(residues, 5) ELSE residues END", lambda d: edits.insert_gap(d, 1, 4))
_edit("delete_at", "CASE WHEN row_idx = 1 THEN substr(residues, 1, 4) || substr(residues, 6) ELSE residues END", lambda d: edits.delete_at(d, 1, 4))
_edit("blank_cells", "CASE WHEN row_idx >= 2 AND row_idx < 5 THEN substr(residues, 1, 3) || repeat('-', greatest(0, least(length(residues), 12) - 3)) || substr(residues, 13) ELSE residues END", lambda d: edits.blank_cells(d, (2, 5), (3, 12)))


@query(_sql(_TEXTS, "SELECT aln_id, CAST(row_number() OVER (PARTITION BY aln_id ORDER BY CASE row_idx WHEN 5 THEN 0 WHEN 0 THEN 1 ELSE 2 END) - 1 AS INT) AS row_idx, substr(residues, 3, 8) AS residues FROM gapped WHERE row_idx IN (5, 0, 3)"))
def subset(spark, sf):
    return edits.subset(gapped(spark, sf), [5, 0, 3], 2, 10).select(*_KEYS)


@query(_sql(_TEXTS, "SELECT aln_id, row_idx FROM texts WHERE id = 'seq42'"))
def find_by_id(spark, sf):
    return edits.find_by_id(texts(spark, sf), "seq42")


@query(_sql(_TEXTS, "SELECT aln_id, CAST(CASE WHEN row_idx = 6 THEN 1 WHEN row_idx BETWEEN 1 AND 5 THEN row_idx + 1 ELSE row_idx END AS INT) AS row_idx, id FROM texts"))
def move_sequence(spark, sf):
    return edits.move_sequence(texts(spark, sf), 6, 1).select("aln_id", "row_idx", "id")


@query(_sql(_TEXTS, "SELECT aln_id, CAST(CASE WHEN row_idx > 4 THEN row_idx - 1 ELSE row_idx END AS INT) AS row_idx, id FROM texts WHERE row_idx <> 4"))
def remove_sequence(spark, sf):
    return edits.remove_sequence(texts(spark, sf), 4).select("aln_id", "row_idx", "id")


@query(_sql(_TEXTS, "SELECT aln_id, CAST(row_number() OVER (PARTITION BY aln_id ORDER BY length(replace(residues, '-', '')) DESC, row_idx) - 1 AS INT) AS row_idx, id FROM gapped"))
def sort_by_length(spark, sf):
    return edits.sort_by_length(gapped(spark, sf)).select("aln_id", "row_idx", "id")


@query(_sql(_TEXTS, "SELECT aln_id, CAST(row_number() OVER (PARTITION BY aln_id ORDER BY CAST(substr(id, 4) AS BIGINT)) - 1 AS INT) AS row_idx, id FROM texts"))
def natural_sort(spark, sf):
    shuffled = edits.renumber(texts(spark, sf), F.reverse("id"))
    return edits.sort_by_name(shuffled).select("aln_id", "row_idx", "id")


@query(_sql(_TEXTS, "SELECT aln_id, row_idx, CASE WHEN k = 1 THEN source ELSE source || '_' || k END AS id FROM (SELECT aln_id, row_idx, description AS source, row_number() OVER (PARTITION BY aln_id, description ORDER BY row_idx) AS k FROM texts)"))
def dedupe_ids(spark, sf):
    return edits.deduplicate_ids(texts(spark, sf).withColumn("id", F.col("description"))).select("aln_id", "row_idx", "id")


_OCC = "occ AS (SELECT aln_id, col, count(*) FILTER (res <> '-') AS occ FROM fc GROUP BY ALL)"


_TWO = "fc2 AS (SELECT aln_id || '/' || (row_idx // 2) AS aln_id, row_idx, col, res FROM fc)"


def _couples(spark, sf):
    """Every two rows of a family as an alignment of their own, so that some columns are all gaps."""
    return family(spark, sf).withColumn("aln_id", F.concat_ws("/", "aln_id", F.floor(F.col("row_idx") / 2)))


@query(_sql(_FAMILY + "," + _TWO, "SELECT aln_id, col FROM fc2 GROUP BY ALL HAVING count(*) FILTER (res <> '-') = 0"))
def all_gap_columns(spark, sf):
    return edits.all_gap_columns(_couples(spark, sf))


@query(_sql(_FAMILY + "," + _TWO, "SELECT aln_id, row_idx, string_agg(res, '' ORDER BY col) AS residues FROM fc2 JOIN (SELECT aln_id, col FROM fc2 GROUP BY ALL HAVING count(*) FILTER (res <> '-') > 0) USING (aln_id, col) GROUP BY ALL"))
def remove_all_gap_columns(spark, sf):
    return edits.remove_all_gap_columns(_couples(spark, sf)).select(*_KEYS)


# Statistics

_CORE = "ACDEFGHIKLMNPQRSTVWY"
_STATS = f"""
cnt AS (SELECT aln_id, col, res, count(*) AS n FROM fc WHERE res <> '-' GROUP BY ALL),
top AS (SELECT aln_id, col, sum(n) AS occupancy, coalesce(sum(n) FILTER (strpos('{_CORE}', res) = 0), 0) AS ambiguous, count(*) FILTER (strpos('{_CORE}', res) > 0) AS dist,
  max(n) FILTER (strpos('{_CORE}', res) > 0) AS best FROM cnt GROUP BY ALL),
maj AS (SELECT aln_id, col, min_by(res, strpos('{_CORE}', res)) AS majority FROM cnt JOIN top USING (aln_id, col) WHERE n = best AND strpos('{_CORE}', res) > 0 GROUP BY ALL),
cs AS (SELECT w.aln_id, w.col, CAST(coalesce(occupancy, 0) AS BIGINT) AS occupancy, CAST(16 AS BIGINT) AS rows, majority, CAST(coalesce(best, 0) AS BIGINT) AS majority_count, CAST(coalesce(dist, 0) AS BIGINT) AS "distinct", CAST(coalesce(ambiguous, 0) AS BIGINT) AS ambiguous
  FROM (SELECT DISTINCT aln_id, col FROM fc) w LEFT JOIN top USING (aln_id, col) LEFT JOIN maj USING (aln_id, col))"""


@query(_sql(_FAMILY + "," + _STATS, "SELECT * FROM cs"))
def column_stats(spark, sf):
    return stats.column_stats(family(spark, sf), PROTEIN)


@query(_sql(_FAMILY + "," + _STATS, "SELECT aln_id, string_agg(CASE WHEN occupancy = 0 OR CAST(occupancy AS FLOAT) / 16 < CAST(0.05 AS FLOAT) THEN '-' WHEN majority IS NOT NULL AND CAST(majority_count AS FLOAT) / CAST(occupancy AS FLOAT) >= CAST(0.5 AS FLOAT) THEN majority ELSE 'X' END, '' ORDER BY col) AS residues FROM cs GROUP BY aln_id"))
def consensus(spark, sf):
    return stats.consensus(family(spark, sf), PROTEIN)


@query(_sql(_FAMILY + "," + _STATS, "SELECT aln_id, round(avg(CASE WHEN majority_count = 16 THEN 1 ELSE 0 END), 6) AS conserved_fraction FROM cs GROUP BY aln_id"))
def conserved_fraction(spark, sf):
    return stats.conserved_fraction(family(spark, sf), PROTEIN).withColumn("conserved_fraction", F.round("conserved_fraction", 6))


@query(
    _sql(
        _FAMILY + "," + _STATS,
        f"""SELECT aln_id, CAST(16 AS BIGINT) AS rows, columns, conserved_fraction, all_gap_columns, mean_residues, mean_ambiguity
FROM (SELECT aln_id, count(*) AS columns, round(avg(CASE WHEN majority_count = 16 THEN 1 ELSE 0 END), 6) AS conserved_fraction, count(*) FILTER (occupancy = 0) AS all_gap_columns FROM cs GROUP BY aln_id)
JOIN (SELECT aln_id, round(avg(length(replace(residues, '-', ''))), 6) AS mean_residues, round(avg(coalesce(length(translate(residues, '-{_CORE}', '')) / nullif(length(replace(residues, '-', '')), 0), 0)), 6) AS mean_ambiguity FROM family GROUP BY aln_id) USING (aln_id)""",
    )
)
def alignment_summary(spark, sf):
    s = stats.summary(family(spark, sf), PROTEIN)
    return s.select("aln_id", "rows", "columns", *[F.round(c, 6).alias(c) for c in ("conserved_fraction", "mean_residues", "mean_ambiguity")], "all_gap_columns")


_PAIRS = "pr AS (SELECT a.aln_id, a.row_idx AS i, b.row_idx AS j, count(*) FILTER (a.res <> '-' AND b.res <> '-') AS n, count(*) FILTER (a.res <> '-' AND a.res = b.res) AS same FROM fc a JOIN fc b USING (aln_id, col) WHERE a.row_idx > b.row_idx GROUP BY ALL)"


@query(_sql(_FAMILY + ",\n" + _PAIRS, "SELECT aln_id, i, j, round(same / nullif(n, 0), 5) AS identity FROM pr"))
def pairwise_identity(spark, sf):
    return stats.match_counts(family(spark, sf)).select("aln_id", "i", "j", F.round(F.try_divide(F.col("same").cast("double"), F.col("both")), 5).alias("identity"))


@query(_sql(_FAMILY + ",\n" + _PAIRS, "SELECT aln_id, round(avg(same / nullif(n, 0)), 4) AS mean_identity FROM pr GROUP BY aln_id"))
def mean_identity(spark, sf):
    return stats.mean_pairwise_identity(family(spark, sf)).withColumn("mean_identity", F.round("mean_identity", 4))


@query(_sql(_FAMILY + ",\n" + _PAIRS, "SELECT aln_id, i, j, round(coalesce((n - same) / nullif(n, 0), 0), 6) AS p FROM pr"))
def p_distance(spark, sf):
    return distances.p_distance(family(spark, sf)).withColumn("p", F.round("p", 6))


@query(_sql(_FAMILY + ",\n" + _PAIRS + ", pd AS (SELECT aln_id, i, j, coalesce((n - same) / nullif(n, 0), 0) AS p FROM pr)", "SELECT aln_id, i, j, round(CASE WHEN p <= 0 THEN 0 WHEN p >= 0.75 THEN 5 ELSE -0.75 * ln(1 - 4 * p / 3) END, 6) AS d FROM pd"))
def jukes_cantor(spark, sf):
    return distances.corrected(family(spark, sf), DNA).withColumn("d", F.round("d", 6))


@query(_sql(_FAMILY + ",\n" + _PAIRS + ", pd AS (SELECT aln_id, i, j, coalesce((n - same) / nullif(n, 0), 0) AS p FROM pr)", "SELECT aln_id, i, j, round(CASE WHEN p <= 0 THEN 0 WHEN p < 0.75 THEN -ln(1 - p - 0.2 * p * p) ELSE least(5, -ln(1 - 0.75 - 0.2 * 0.5625) + (p - 0.75) / 0.25 * (5 + ln(1 - 0.75 - 0.2 * 0.5625))) END, 6) AS d FROM pd"))
def kimura(spark, sf):
    return distances.corrected(family(spark, sf), PROTEIN).withColumn("d", F.round("d", 6))


@query(
    _sql(
        _FAMILY,
        """, per AS (SELECT aln_id, col, res, count(*) AS n FROM fc GROUP BY ALL), kinds AS (SELECT *, count(*) OVER (PARTITION BY aln_id, col) AS k FROM per),
raw AS (SELECT aln_id, row_idx, coalesce(sum(1.0 / (k * n)) FILTER (k > 1), 0) AS raw FROM fc JOIN kinds USING (aln_id, col, res) GROUP BY ALL)
SELECT aln_id, row_idx, round(CASE WHEN avg(raw) OVER (PARTITION BY aln_id) > 0 THEN greatest(raw / avg(raw) OVER (PARTITION BY aln_id), 1e-4) ELSE 1 END, 6) AS weight FROM raw""",
    )
)
def henikoff_weights(spark, sf):
    return stats.henikoff_weights(family(spark, sf)).withColumn("weight", F.round("weight", 6))


_KMERS = "km AS (SELECT aln_id, row_idx, kmer, count(*) AS n FROM (SELECT aln_id, row_idx, unnest(list_transform(range(1, length(residues) - 4), lambda i: substr(residues, i, 6))) AS kmer FROM dna WHERE length(residues) >= 6) GROUP BY ALL)"


@query(_sql(_TEXTS + ",\n" + _KMERS, "SELECT * FROM km"))
def kmer_counts(spark, sf):
    return distances.kmer_counts(dna(spark, sf), DNA)


@query(
    _sql(
        _TEXTS + ",\n" + _KMERS,
        """, tot AS (SELECT aln_id, row_idx, coalesce(sum(n), 0) AS t FROM dna LEFT JOIN km USING (aln_id, row_idx) GROUP BY ALL),
sh AS (SELECT a.aln_id, a.row_idx AS i, b.row_idx AS j, sum(least(a.n, b.n)) AS s FROM km a JOIN km b USING (aln_id, kmer) WHERE a.row_idx > b.row_idx GROUP BY ALL)
SELECT a.aln_id, a.row_idx AS i, b.row_idx AS j, round(CASE WHEN least(a.t, b.t) = 0 THEN 1 ELSE greatest(0, 1 - coalesce(s, 0) / least(a.t, b.t)) END, 6) AS d
FROM tot a JOIN tot b USING (aln_id) LEFT JOIN sh ON sh.aln_id = a.aln_id AND sh.i = a.row_idx AND sh.j = b.row_idx WHERE a.row_idx > b.row_idx""",
    )
)
def kmer_distance(spark, sf):
    return distances.kmer_distance(dna(spark, sf), DNA).withColumn("d", F.round("d", 6))


@query(_sql(_FAMILY, "SELECT aln_id, CAST(1 AS DOUBLE) AS sp, CAST(1 AS DOUBLE) AS tc FROM family GROUP BY aln_id"))
def accuracy_self(spark, sf):
    f = family(spark, sf)
    return stats.accuracy(f, f).select("aln_id", F.round("sp", 6).alias("sp"), F.round("tc", 6).alias("tc"))


# Filters and blocks


@query(_sql(_FAMILY, "SELECT aln_id, col, CAST(count(*) FILTER (res = '-') AS FLOAT) / 16 <= CAST(0.1 AS FLOAT) AS keep FROM fc GROUP BY ALL"))
def gappy_columns(spark, sf):
    return clean.gappy_columns(family(spark, sf), 0.1)


@query(_sql(_TEXTS + ",\n" + _PAD, "SELECT aln_id, row_idx, w = 0 OR CAST(w - length(translate(residues, '-?', '')) AS FLOAT) / CAST(w AS FLOAT) <= CAST(0.6 AS FLOAT) AS keep FROM padded"))
def gappy_sequences(spark, sf):
    return clean.gappy_sequences(gapped(spark, sf), 0.6)


@query(_sql(_FAMILY, ", ok AS (SELECT aln_id, col FROM fc GROUP BY ALL HAVING CAST(count(*) FILTER (res <> '-') AS FLOAT) / 16 >= CAST(0.97 AS FLOAT)) SELECT aln_id, CAST(coalesce(min(ok.col), 0) AS INT) AS start, CAST(coalesce(max(ok.col) + 1, 0) AS INT) AS \"end\" FROM (SELECT DISTINCT aln_id FROM fc) a LEFT JOIN ok USING (aln_id) GROUP BY aln_id"))
def trim_ends(spark, sf):
    return clean.trim_ends(family(spark, sf), 0.97)


def _blocks_sql(b2: int, b4: int, allowed: str, b5_all: bool, out: str) -> str:
    from strandline.alphabet import SIMILAR

    sim = ", ".join(f"('{a}','{b}')" for a, bs in SIMILAR.items() for b in bs)
    drop = "TRUE" if b5_all else "NOT (bad AND gappy)"
    return _sql(
        _FAMILY,
        f""", let AS (SELECT aln_id, col, res, count(*) AS n FROM fc WHERE res NOT IN ('-', '?') GROUP BY ALL),
tops AS (SELECT *, first_value(res) OVER (PARTITION BY aln_id, col ORDER BY n DESC, res) AS top, max(n) OVER (PARTITION BY aln_id, col) AS ident, sum(n) OVER (PARTITION BY aln_id, col) AS filled FROM let),
sim(x, y) AS (VALUES {sim}),
tal AS (SELECT aln_id, col, max(ident) AS ident, max(filled) AS filled, sum(CASE WHEN res = top OR y IS NOT NULL THEN n ELSE 0 END) AS simi FROM tops LEFT JOIN sim ON x = top AND y = res GROUP BY ALL),
flg AS (SELECT aln_id, col, CASE WHEN NOT ({allowed}) THEN 'GapRich' WHEN (CASE WHEN ident * 2 > 16 THEN simi ELSE ident END) >= {b2} THEN 'HighlyConserved' WHEN ident >= 9 THEN 'Conserved' ELSE 'NonConserved' END AS flag
  FROM (SELECT c.aln_id, c.col, coalesce(ident, 0) AS ident, coalesce(simi, 0) AS simi, 16 - coalesce(filled, 0) AS gaps FROM (SELECT DISTINCT aln_id, col FROM fc) c LEFT JOIN tal USING (aln_id, col))),
r1 AS (SELECT *, sum(st) OVER (PARTITION BY aln_id ORDER BY col) AS run FROM (SELECT *, CASE WHEN bad IS DISTINCT FROM lag(bad) OVER (PARTITION BY aln_id ORDER BY col) THEN 1 ELSE 0 END AS st FROM (SELECT *, flag IN ('NonConserved', 'GapRich') AS bad FROM flg))),
r2 AS (SELECT *, NOT (bad AND len > 8) AS sel FROM (SELECT *, count(*) OVER (PARTITION BY aln_id, run) AS len, bool_or(flag = 'GapRich') OVER (PARTITION BY aln_id, run) AS gappy FROM r1)),
r3 AS (SELECT *, sum(st2) OVER (PARTITION BY aln_id ORDER BY col) AS part FROM (SELECT *, CASE WHEN sel IS DISTINCT FROM lag(sel) OVER (PARTITION BY aln_id ORDER BY col) THEN 1 ELSE 0 END AS st2 FROM r2)),
r4 AS (SELECT *, coalesce(sel AND col >= min(CASE WHEN flag = 'HighlyConserved' THEN col END) OVER (PARTITION BY aln_id, part) AND col <= max(CASE WHEN flag = 'HighlyConserved' THEN col END) OVER (PARTITION BY aln_id, part), FALSE) AND {drop} AS kept FROM r3),
r5 AS (SELECT *, sum(st3) OVER (PARTITION BY aln_id ORDER BY col) AS blk FROM (SELECT *, CASE WHEN kept IS DISTINCT FROM lag(kept) OVER (PARTITION BY aln_id ORDER BY col) THEN 1 ELSE 0 END AS st3 FROM r4)),
msk AS (SELECT aln_id, col, flag, blk, kept AND count(*) OVER (PARTITION BY aln_id, blk) >= {b4} AS keep FROM r5)
{out}""",
    )


_VARIANTS = {
    "default": (clean.Blocks(), 14, 10, "gaps = 0", False),
    "half": (clean.Blocks(b5=clean.HALF), 14, 10, "gaps * 2 < 16", False),
    "all": (clean.Blocks(b5=clean.ALL), 14, 10, "TRUE", True),
    "relaxed": (clean.Blocks.relaxed(), 9, 5, "gaps * 2 < 16", False),
}
for _name, (_p, _b2, _b4, _ok, _all) in _VARIANTS.items():
    query(_blocks_sql(_b2, _b4, _ok, _all, "SELECT aln_id, col, flag, keep FROM msk"), f"blocks_mask_{_name}")(lambda spark, sf, p=_p: clean.block_mask(family(spark, sf), PROTEIN, p))
query(_blocks_sql(14, 10, "gaps * 2 < 16", False, "SELECT aln_id, CAST(min(col) AS INT) AS start, CAST(max(col) + 1 AS INT) AS \"end\" FROM msk WHERE keep GROUP BY aln_id, blk"), "blocks_ranges")(lambda spark, sf: clean.blocks(clean.block_mask(family(spark, sf), PROTEIN, clean.Blocks(b5=clean.HALF))))
query(_blocks_sql(14, 10, "gaps * 2 < 16", False, "SELECT aln_id, row_idx, coalesce(string_agg(CASE WHEN keep THEN res END, '' ORDER BY col), '') AS residues FROM msk JOIN fc USING (aln_id, col) GROUP BY ALL"), "blocks_apply")(
    lambda spark, sf: edits.keep_columns(family(spark, sf), clean.block_mask(family(spark, sf), PROTEIN, clean.Blocks(b5=clean.HALF))).select(*_KEYS)
)
query(_blocks_sql(14, 10, "gaps = 0", False, "SELECT aln_id, string_agg(CASE WHEN keep THEN '#' ELSE ' ' END, '' ORDER BY col) AS line, CAST(count(*) FILTER (keep) AS BIGINT) AS kept, CAST(count(*) AS BIGINT) AS total FROM msk GROUP BY aln_id"), "blocks_line")(lambda spark, sf: clean.mask_line(clean.block_mask(family(spark, sf), PROTEIN)))

QUERIES, ORACLES = _QUERIES, _ORACLES
