"""Alphabets and residue classes, as plain strings for use in native expressions."""

from __future__ import annotations

DNA, RNA, PROTEIN = "DNA", "RNA", "protein"
GAP, MISSING = "-", "?"
#: What counts as a gap in sequences; cleaning also takes MISSING as blank.
GAPS, BLANKS = "-.~", "-.~?"
SYMBOLS = {DNA: "ACGTRYSWKMBDHVN", RNA: "ACGURYSWKMBDHVN", PROTEIN: "ACDEFGHIKLMNPQRSTVWYBZXJUO"}
CORE = {DNA: "ACGT", RNA: "ACGU", PROTEIN: "ACDEFGHIKLMNPQRSTVWY"}
UNKNOWN = {DNA: "N", RNA: "N", PROTEIN: "X"}
NEXUS_TYPE = {DNA: "dna", RNA: "rna", PROTEIN: "protein"}
#: Letters that a nucleotide alphabet does not call ambiguous.
NUCLEOTIDES = "ACGTU"
#: IUPAC complements.
COMPLEMENT_FROM = "ACGTURYSWKMBDHVN"
COMPLEMENT_TO = {DNA: "TGCAAYRSWMKVHDBN", RNA: "UGCAAYRSWMKVHDBN"}
#: Amino acids that score above zero with each other in the usual substitution table.
SIMILAR = {
    "A": "AS", "R": "RQK", "N": "NDHS", "D": "NDE", "C": "C", "Q": "RQEK", "E": "DQEK", "G": "G", "H": "NHY",
    "I": "ILMV", "L": "ILMV", "M": "ILMV", "V": "ILMV", "K": "RQEK", "F": "FWY", "P": "P", "S": "ANST", "T": "ST",
    "W": "FWY", "Y": "HFWY",
}
#: Groups that amino acids are reduced to before k-mers are counted.
GROUPS = ("AGST", "C", "DENQ", "FWY", "HKR", "ILMV", "P")
KMER = {DNA: 6, RNA: 6, PROTEIN: 3}
