"""Native column functions over residues, headers and scores; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.alphabet import BLANKS, COMPLEMENT_FROM, COMPLEMENT_TO, CORE, DNA, GAPS, GROUPS, NUCLEOTIDES, PROTEIN, SYMBOLS

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def upper(c: Column) -> Column:
    """Upper case of ASCII letters only, so the length never changes."""
    return F.translate(c, _LOW, _UP)


def normalize(residues: Column) -> Column:
    """Gap aliases become '-'."""
    return F.translate(residues, ".~", "--")


def without(residues: Column, chars: str) -> Column:
    return F.translate(residues, chars, "")


def ungapped(residues: Column) -> Column:
    return without(residues, GAPS)


def ungapped_length(residues: Column) -> Column:
    return F.length(ungapped(residues))


def blanks(residues: Column) -> Column:
    """Number of gaps and missing marks."""
    return F.length(residues) - F.length(without(residues, BLANKS))


def header(id: Column, description: Column) -> Column:
    return F.concat_ws(" ", id, F.when(description != "", description))


def header_id(h: Column) -> Column:
    return F.regexp_extract(F.trim(h), r"^(\S*)", 1)


def header_description(h: Column) -> Column:
    return F.trim(F.regexp_extract(F.trim(h), r"^\S*\s*([\s\S]*)$", 1))


def residue_index(residues: Column, col: Column) -> Column:
    """Number of residues before a column; null at a gap or outside the row. Columns count from 0."""
    here = F.substring(residues, col + 1, F.lit(1))
    return F.when((col >= 0) & (col < F.length(residues)) & ~here.isin(*GAPS), F.length(ungapped(F.substring(residues, F.lit(1), col))))


def complement(residues: Column, alphabet: str) -> Column:
    if alphabet == PROTEIN:
        return residues
    to = COMPLEMENT_TO[alphabet]
    return F.translate(residues, COMPLEMENT_FROM + COMPLEMENT_FROM.lower(), to + to.lower())


def reverse_complement(residues: Column, alphabet: str = DNA) -> Column:
    """For proteins the row is still reversed."""
    return F.reverse(complement(residues, alphabet))


def pad(residues: Column, width: Column) -> Column:
    return F.concat(residues, F.repeat(F.lit("-"), F.greatest(F.lit(0), width - F.length(residues)).cast("int")))


def pad_quality(quality: Column, width: Column) -> Column:
    return F.concat(quality, F.array_repeat(F.lit(0).cast("smallint"), F.greatest(F.lit(0), width - F.size(quality)).cast("int")))


def cells_of(residues: Column) -> Column:
    """Residues as an array; an empty row has no cells."""
    return F.when(F.length(residues) > 0, F.split(residues, "")).otherwise(F.array().cast("array<string>"))


def ambiguity_fraction(residues: Column, alphabet: str) -> Column:
    """Share of the residues that don't name one base or amino acid; 0 for a row without residues."""
    core = NUCLEOTIDES if alphabet != PROTEIN else CORE[PROTEIN]
    r = upper(ungapped(residues))
    return F.coalesce(F.try_divide(F.length(without(r, core)).cast("double"), F.length(r)), F.lit(0.0))


def is_gap(c: Column) -> Column:
    return c.isin(*GAPS)


def is_blank(c: Column) -> Column:
    return c.isin(*BLANKS)


def is_valid(c: Column, alphabet: str) -> Column:
    return upper(c).isin(*SYMBOLS[alphabet]) | c.isin(*BLANKS)


def is_ambiguous(c: Column, alphabet: str) -> Column:
    core = NUCLEOTIDES if alphabet != PROTEIN else CORE[PROTEIN]
    return ~upper(c).isin(*core)


def jukes_cantor(p: Column) -> Column:
    return F.when(p <= 0, 0.0).when(p >= 0.75, 5.0).otherwise(-0.75 * F.ln(1 - 4 * F.when((p > 0) & (p < 0.75), p).otherwise(0.0) / 3))


def kimura_protein(p: Column) -> Column:
    """-ln(1 - p - p^2 / 5) up to p = 0.75, then a line to 5 at p = 1."""
    import math

    knee = -math.log(1 - 0.75 - 0.2 * 0.75**2)
    line = F.lit(knee) + (p - 0.75) / 0.25 * (5.0 - knee)
    q = F.least(p, F.lit(0.75))
    return F.when(p <= 0, 0.0).when(p < 0.75, -F.ln(1 - q - 0.2 * q * q)).otherwise(F.least(line, F.lit(5.0)))


def kmer_letters(residues: Column, alphabet: str) -> Column:
    """Residues as k-mers see them: T for U, amino acids by the first letter of their group, '.' for others."""
    r = upper(residues)
    if alphabet != PROTEIN:
        return F.regexp_replace(F.translate(r, "U", "T"), "[^ACGT]", ".")
    members = "".join(GROUPS)
    return F.regexp_replace(F.translate(r, members, "".join(g[0] * len(g) for g in GROUPS)), f"[^{''.join(g[0] for g in GROUPS)}]", ".")


def kmers(residues: Column, k: int, alphabet: str) -> Column:
    """All k-mers of letters that have a code."""

    def of(c: Column) -> Column:  # the letters are worked out once, as a lambda's argument
        at = F.when(F.size(c) >= k, F.sequence(F.lit(0), F.size(c) - k)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(at, lambda i: F.concat(*[F.get(c, i + j) for j in range(k)])), lambda x: ~F.contains(x, F.lit(".")))

    return F.get(F.transform(F.array(cells_of(kmer_letters(residues, alphabet))), of), F.lit(0))


def natural_key(name: Column) -> Column:
    """A sort key in which digit runs compare as numbers and ASCII letters without case (over 38 digits: 0)."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9])"), F.lit(1))
    digits = F.lit(r"^[0-9]+$")
    return F.transform(
        parts,
        lambda x: F.struct(
            F.when(F.regexp_like(x, digits), 48).otherwise(F.ascii(x)).alias("ord"),
            F.when(F.regexp_like(x, digits) & (F.length(x) <= 38), x.try_cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")).alias("num"),
        ),
    )


def residue_class(c: Column, alphabet: str) -> Column:
    """A colour class: the base for nucleotides, a physico-chemical group for amino acids."""
    u = upper(c)
    if alphabet != PROTEIN:
        return F.when(u.isin("A", "C", "G"), u).when(u.isin("T", "U"), "T").when(is_blank(c), "gap").otherwise("other")
    out = F.when(is_blank(c), "gap")
    for name, letters in {"aliphatic": "AILMV", "aromatic": "FWY", "positive": "HKR", "negative": "DE", "polar": "NQST", "cysteine": "C", "glycine": "G", "proline": "P"}.items():
        out = out.when(u.isin(*letters), name)
    return out.otherwise("other")


def quality_class(q: Column) -> Column:
    return F.when(q > F.lit(0.9).cast("float"), "high").when(q > F.lit(0.6).cast("float"), "middle").otherwise("low")
