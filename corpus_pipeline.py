"""The corpus pipeline: quality classifier, near-duplicates, benchmark passages, piece ids.

Each stage takes the rows its predecessor kept, as columns of ``documents``, and is written and
read again before the next one. All but the last return these columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sweepledger.llm.catalog import PIECES
from sweepledger.llm.piece_rounds import encode_pieces, piece_digest
from sweepledger.llm.positional_index import keep_clean
from sweepledger.llm.rule_ensemble import keep_accepted
from sweepledger.llm.shared import table
from sweepledger.llm.simhash import keep_one
from sweepledger.session import drop_scratch, scratch_mark, scratch_since, stage_at


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage_of_pipeline(function: Stage) -> Stage:
    """A stage that first drops what the one before wrote for itself.

    That one's result is written by then, and ``docs`` is read from it; if ``docs`` still reads from such a folder, nothing is dropped.
    """

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        context = spark.sparkContext
        old = getattr(context, "_corpus_pipeline_scratch", [])
        files = docs.inputFiles()
        if not any(path.split(":", 1)[-1].strip("/") in f for path in old for f in files):
            drop_scratch(spark, 0, keep=[path for path in scratch_since(spark, 0) if path not in old])
        mark = scratch_mark(spark)
        result = function(spark, docs, sf_dir)
        context._corpus_pipeline_scratch = scratch_since(spark, mark)
        return result

    return run


@stage_of_pipeline
def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learnt from the labels, scores at least 0.3."""
    return keep_accepted(docs, table(spark, sf_dir, "labels"))


@stage_of_pipeline
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, by the operator's own law: three-word shingles, three differing bits at most."""
    return keep_one(docs)


@stage_of_pipeline
def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item (or all of a shorter one)."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


@stage_of_pipeline
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its piece ids and their digests."""
    return piece_digest(encode_pieces(docs.select("doc_id", "text"), PIECES), "ids")


STAGES = [
    ("quality_classifier", accept_quality),
    ("simhash_near_duplicates", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("piece_encoding", encode),
]

# Neither the model's scores, XXH64 nor piece ids can be expressed in SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``. What a stage wrote for itself is dropped when its result is written, and a result
    when the next one is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, function in STAGES[:-1]:
        mark = scratch_mark(spark)
        docs, path = stage_at(function(spark, docs, sf_dir), name)
        drop_scratch(spark, mark if before is None else mark - 1, keep=[path])
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
