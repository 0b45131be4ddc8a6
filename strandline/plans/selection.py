"""Selections as row and column ranges, and as predicates on cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Selection:
    """From anchor to cursor (row, column); mode cells, columns or rows."""

    anchor: tuple[int, int] = (0, 0)
    cursor: tuple[int, int] = (0, 0)
    mode: str = "cells"
    active: bool = False

    def rows(self, count: int) -> range:
        if not self.active or self.mode == "columns":
            return range(count)
        lo, hi = sorted((self.anchor[0], self.cursor[0]))
        return range(min(lo, count), min(hi + 1, count))

    def cols(self, width: int) -> range:
        if not self.active or self.mode == "rows":
            return range(width)
        lo, hi = sorted((self.anchor[1], self.cursor[1]))
        return range(min(lo, width), min(hi + 1, width))

    def contains(self, rows: int, width: int) -> Column:
        r, c = self.rows(rows), self.cols(width)
        return F.lit(self.active) & (F.col("row_idx") >= r.start) & (F.col("row_idx") < r.stop) & (F.col("col") >= c.start) & (F.col("col") < c.stop)

    def cell_count(self, rows: int, width: int) -> int:
        return len(self.rows(rows)) * len(self.cols(width)) if self.active else 0
