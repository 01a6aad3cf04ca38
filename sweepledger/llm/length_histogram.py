"""Exact histogram of encoded lengths, and what its suffix sums answer for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .byte_pairs import byte_pairs
from .shared import ship, slices

BLOCK = 256


def encoded_lengths(docs: DataFrame, tokenizer: str, end_ids: int = 0) -> DataFrame:
    """``(length)`` of each row's whole text in ids of the byte-level tokenizer, with ``end_ids`` more. No shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = byte_pairs(tokenizer)
        for batch in slices(batches, "text"):
            ids = known.encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([len(i) // 4 + end_ids for i in ids], pa.int64())], ["length"])

    return docs.select("text").mapInArrow(run, "length long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """``(length, n_docs)``: one row per distinct length, summed before the shuffle. Null lengths count nowhere."""
    return lengths.where("length IS NOT NULL").groupBy("length").agg(F.count("*").alias("n_docs"))


def context_answers(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a context limit:

    ``n_docs`` and ``n_tokens`` of this length; ``docs_from`` and ``tokens_from``, suffix sums
    over this length and all longer ones; ``fitting_docs``, documents up to this length;
    ``quantile``, their share; ``truncated_tokens``, the total if every document is cut to this length.
    Between two lengths the answers follow from the next longer one (see ``at_limits``).

    Suffix sums go in two steps, within blocks of 256 lengths and over the blocks' totals,
    so that no task sorts the whole histogram. The histogram, which both steps read, is written once to the shared
    checkpoint folder. An empty one gives no rows.
    """
    blocks = stage(histogram, "histogram").select(
        F.floor(F.col("length") / BLOCK).alias("block"), "length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens")
    )
    longer = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = blocks.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("tokens"))
    beyond = totals.select(
        "block",
        F.coalesce(F.sum("docs").over(longer), F.lit(0)).alias("docs_beyond"),
        F.coalesce(F.sum("tokens").over(longer), F.lit(0)).alias("tokens_beyond"),
        F.sum("docs").over(everything).alias("all_docs"),
        F.sum("tokens").over(everything).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    summed = (
        blocks.join(beyond, "block")
        .withColumn("docs_from", F.sum("n_docs").over(within) + F.col("docs_beyond"))
        .withColumn("tokens_from", F.sum("n_tokens").over(within) + F.col("tokens_beyond"))
    )
    fitting = F.col("all_docs") - F.col("docs_from") + F.col("n_docs")
    return summed.select(
        "length",
        "n_docs",
        "n_tokens",
        "docs_from",
        "tokens_from",
        fitting.alias("fitting_docs"),
        (fitting / F.col("all_docs")).alias("quantile"),
        (F.col("all_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_tokens"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``(context_limit, fitting_docs, truncated_tokens)`` for any limits, straight from the histogram."""
    cut = F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("context_limit")
    return (
        histogram.select(cut, "length", "n_docs")
        .groupBy("context_limit")
        .agg(
            F.sum(F.when(F.col("length") <= F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("fitting_docs"),
            F.sum(F.least("length", "context_limit") * F.col("n_docs")).alias("truncated_tokens"),
        )
    )


def quantile_length(histogram: DataFrame, share: float) -> DataFrame:
    """One row: the smallest length with at least ``share`` of all documents up to it; null without documents."""
    return context_answers(histogram).where(F.col("quantile") >= share).agg(F.min("length").alias("length"))
