"""First, last and matching lines of logs.

Two forms. Whole logs held in one column are cut by array functions, without a
shuffle. Line tables use a row number per log with a bound, which Spark also
applies before the shuffle, so a log of any size sends a few lines per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed_values import BLAME_PATTERNS, DIFF_LINES, ERROR_LINES, TAIL_LINES
from ..functions.lines import blamed_crate, clean_gap_line, is_entry, is_error_line, split_lines


def _explode_numbered(texts: DataFrame, content: str, numbered: Column) -> DataFrame:
    others = [c for c in texts.columns if c != content]
    return texts.select(*others, F.inline(numbered))


def _numbered(content: str, keep=None) -> Column:
    """All lines as ``(line_no, line)`` structs, numbered from 1, then filtered."""
    rows = F.transform(
        split_lines(F.col(content)), lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line"))
    )
    return rows if keep is None else F.filter(rows, lambda row: keep(row["line"]))


def entries(texts: DataFrame, content: str = "content") -> DataFrame:
    """Lines that are neither comments nor empty."""
    return _explode_numbered(texts, content, _numbered(content, is_entry))


def head_of_text(texts: DataFrame, n: int = DIFF_LINES, content: str = "content") -> DataFrame:
    return _explode_numbered(texts, content, F.slice(_numbered(content), 1, n))


def tail_of_text(texts: DataFrame, n: int = TAIL_LINES, content: str = "content") -> DataFrame:
    rows = _numbered(content)
    start = F.greatest(F.lit(1), F.size(rows) - n + 1)
    return _explode_numbered(texts, content, F.slice(rows, start, F.lit(n)))


def errors_of_text(texts: DataFrame, n: int = ERROR_LINES, content: str = "content") -> DataFrame:
    return _explode_numbered(texts, content, F.slice(_numbered(content, is_error_line), 1, n))


def head_lines(lines: DataFrame, keys: Sequence[str], n: int = DIFF_LINES, last: bool = False) -> DataFrame:
    """The first (or last) ``n`` lines of each log of a line table."""
    order = F.desc("line_no") if last else F.asc("line_no")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return lines.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def tail_lines(lines: DataFrame, keys: Sequence[str], n: int = TAIL_LINES) -> DataFrame:
    return head_lines(lines, keys, n, last=True)


def error_lines(lines: DataFrame, keys: Sequence[str], n: int = ERROR_LINES) -> DataFrame:
    return head_lines(lines.where(is_error_line(F.col("line"))), keys, n)


def first_blame(
    lines: DataFrame, keys: Sequence[str] = ("slot", "round"), patterns: Sequence[str] = BLAME_PATTERNS
) -> DataFrame:
    """The crate the first blaming line names, per log; null when none blames."""
    crate = F.col("crate")
    first = F.min_by(crate, F.when(crate.isNotNull(), F.col("line_no")))
    blamed = lines.select(*keys, "line_no", blamed_crate(F.col("line"), patterns).alias("crate"))
    return blamed.groupBy(*keys).agg(F.nullif(first, F.lit("")).alias("crate"))


def first_blame_of_text(
    texts: DataFrame, patterns: Sequence[str] = BLAME_PATTERNS, content: str = "content"
) -> DataFrame:
    """As ``first_blame`` for whole logs in one column; no shuffle.

    Lines after the first blaming one are not matched any more.
    """
    first = F.aggregate(
        split_lines(F.col(content)),
        F.lit(None).cast("string"),
        lambda found, line: F.coalesce(found, blamed_crate(line, patterns)),
    )
    others = [c for c in texts.columns if c != content]
    return texts.select(*others, F.nullif(first, F.lit("")).alias("crate"))


def gap_lines(lines: DataFrame) -> DataFrame:
    """Generator output with its prefix replaced by an indent."""
    return lines.withColumn("line", clean_gap_line(F.col("line")))
