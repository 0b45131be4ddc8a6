"""Operators: DataFrame in, DataFrame out.

A set of sequences is a DataFrame with aln_id, row_idx, id, residues and, where it is known, description,
quality and hidden. Rows shorter than the widest one read as gaps beyond their end.
"""
