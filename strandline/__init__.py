"""Sequence analytics on Spark: alignments and sequence sets as DataFrames."""

__version__ = "0.1.0"
