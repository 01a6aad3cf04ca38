"""Reading files as whole texts, as lines and as bytes."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lines import split_lines


# Tasks get these functions whole, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def frames(rows: Iterable[tuple], names: Sequence[str], most: int = 4096) -> Iterator[pd.DataFrame]:
    """Rows as frames of ``most`` rows, so that a batch of texts with very many rows is never held whole."""
    rows = iter(rows)
    while some := list(islice(rows, most)):
        yield pd.DataFrame(some, columns=list(names))


def no_errors(rows: DataFrame) -> DataFrame:
    """Rows of a parser without those that say that a text could not be read (see ``errors_of``)."""
    return rows.where("error IS NULL").drop("error")


def errors_of(rows: DataFrame, source: str = "source") -> DataFrame:
    """``(source, error)`` of texts that could not be read."""
    return rows.where("error IS NOT NULL").select(source, "error").distinct()


def read_texts(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``(path, content)`` for every file below ``root`` whose name matches ``glob``.

    One recursive listing of the root, so that a tree of one small file per
    directory does not become one listing task per directory; Spark packs the
    files into partitions by ``spark.sql.files.maxPartitionBytes`` and
    ``spark.sql.files.openCostInBytes``.
    """
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(path, line)`` of the files whose name matches ``glob``; large files are split among tasks."""
    return spark.read.text(path, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def read_lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line_no, line)`` of files too large to hold; files are split among tasks.

    ``line_no`` only orders the lines of a file: it is the byte a split starts at
    and the row within the split, so no task has to count the lines before it.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(
            F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")
        ).alias("line_no"),
        F.col("value").alias("line"),
    )


def number_lines(texts: DataFrame, content: str = "content") -> DataFrame:
    """One row per line of ``content``, with ``line_no`` from 1; other columns stay."""
    others = [c for c in texts.columns if c != content]
    return texts.select(*others, F.posexplode(split_lines(F.col(content))).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no") + 1
    )


def relative_path(path, root: str):
    """``path`` below ``root``, whatever scheme either was given with."""
    plain = F.regexp_replace(path, r"^[a-z0-9]+:/+", "/")
    base = root.split(":", 1)[-1] if ":/" in root else root
    return F.regexp_replace(plain, F.lit(r"^\Q/" + base.strip("/") + r"\E/"), F.lit(""))
