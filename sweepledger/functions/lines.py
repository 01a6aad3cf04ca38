"""Single lines of lists and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import BLAME_PATTERNS, CANCEL_TEXT, GAP_PREFIX


def is_entry(line: Column) -> Column:
    """True for list entries, false for comments and empty lines."""
    return (line != "") & ~line.startswith("#")


def split_lines(text: Column) -> Column:
    """The lines of a text; a final line feed ends a line and starts none."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)


def blamed_crate(line: Column, patterns: Sequence[str] = BLAME_PATTERNS) -> Column:
    """What a resolver line blames: null when no pattern matches, else the crate.

    The crate may be empty, when a message quotes nothing; such a message still
    counts as the first one, and leaves its log unhandled.
    """
    return F.coalesce(*[F.get(F.regexp_extract_all(line, F.lit(p), F.lit(1)), F.lit(0)) for p in patterns])


def is_cancel_notice(line: Column, text: str = CANCEL_TEXT) -> Column:
    return line.contains(text)


def is_error_line(line: Column) -> Column:
    return F.lower(line).contains("error")


def clean_gap_line(line: Column) -> Column:
    """Replace the generator's prefix by an indent."""
    return F.regexp_replace(line, GAP_PREFIX, "  ")
