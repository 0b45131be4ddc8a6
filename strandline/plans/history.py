"""Versions of a set of sequences. Each edit is a plan over the one before; undo and redo move a pointer.

An edit reads its set twice (rows and width), so plans of edits upon edits would double each time. Where the
session has a checkpoint folder, every STORED-th version is checkpointed there, and plans stay short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

LIMIT, STORED = 200, 2


class History:
    def __init__(self, first: DataFrame, limit: int = LIMIT):
        self._versions: list[tuple[str, DataFrame]] = [("open", first)]
        self._at, self._saved, self.limit, self.revision = 0, first, limit, 0

    @property
    def current(self) -> DataFrame:
        return self._versions[self._at][1]

    @property
    def dirty(self) -> bool:
        return self.current is not self._saved

    def mark_saved(self) -> None:
        self._saved = self.current

    def apply(self, label: str, edit: Callable[[DataFrame], DataFrame]) -> History:
        """A new version after the current one; what was undone is gone. The oldest go beyond the limit."""
        del self._versions[self._at + 1 :]
        self.revision += 1
        new = edit(self.current)
        if self.revision % STORED == 0 and new.sparkSession.sparkContext.getCheckpointDir():
            new = new.checkpoint()
        self._versions.append((label, new))
        del self._versions[: max(0, len(self._versions) - 1 - self.limit)]
        self._at = len(self._versions) - 1
        return self

    def undo(self) -> str | None:
        """The label of what was undone."""
        if not self._at:
            return None
        self._at -= 1
        self.revision += 1
        return self._versions[self._at + 1][0]

    def redo(self) -> str | None:
        if self._at + 1 == len(self._versions):
            return None
        self._at += 1
        self.revision += 1
        return self._versions[self._at][0]
