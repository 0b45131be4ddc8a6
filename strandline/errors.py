"""Errors of the library."""

from __future__ import annotations


class SeqError(Exception):
    """Base of all errors here."""


class ParseError(SeqError):
    def __init__(self, format: str, line: int, message: str):
        super().__init__(f"{format}: line {line}: {message}")
        self.format, self.line, self.message = format, line, message


class FormatError(SeqError):
    """A format can't hold what it is given, or isn't known."""


class NotAlignedError(SeqError):
    """Rows of unequal length where a matrix is needed."""


class OutOfRangeError(SeqError):
    """A row or column outside the alignment."""


class AlgorithmError(SeqError):
    """Parameters or input that an algorithm can't take."""


class CancelledError(SeqError):
    """The caller stopped a long computation."""
