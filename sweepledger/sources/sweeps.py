"""Sweep inputs: build reports, known failures, changed paths, resolver logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import KNOWN_FAILURE_FILE, KNOWN_FAILURE_GLOB
from ..functions.lines import is_entry
from .files import number_lines, read_lines, read_texts

REPORT_SCHEMA = "results MAP<STRING, STRUCT<success: STRING>>"


def explode_results(reports: DataFrame, results: str = "results") -> DataFrame:
    """One row per label; a report without results gives no rows."""
    others = [c for c in reports.columns if c != results]
    return reports.select(*others, F.explode(results).alias("label", "outcome")).select(
        *others, "label", F.col("outcome.success").alias("success")
    )


def parse_reports(texts: DataFrame, content: str = "content") -> DataFrame:
    """Reports held as JSON text in a column."""
    others = [c for c in texts.columns if c != content]
    parsed = texts.select(*others, F.from_json(content, REPORT_SCHEMA)["results"].alias("results"))
    return explode_results(parsed)


RUN_PATTERN = r"([^/]+)/([^/]+)/[^/]+\.json$"


def _of_run(source: Column, run_pattern: str) -> list[Column]:
    return [F.regexp_extract(source, run_pattern, 2).alias("run_id"), F.regexp_extract(source, run_pattern, 1).alias("platform")]


def read_report_files(
    spark: SparkSession, path: str, run_pattern: str = RUN_PATTERN, multi_line: bool = True, glob: str = "*.json"
) -> DataFrame:
    """``(run_id, platform, results, broken)`` of JSON reports; ``broken`` where one is no JSON of the known form.

    ``run_pattern`` takes the platform and the run from the file's path. A report
    is one JSON object, so a file cannot be split: stage it once with
    ``stage_reports`` and audit the staged table. Files with a report per line can
    be split; read them with ``multi_line`` off. A file without content gives no row; see ``read_runs``.
    """
    reports = (
        spark.read.schema(f"{REPORT_SCHEMA}, _broken STRING")
        .option("columnNameOfCorruptRecord", "_broken")
        .option("multiLine", multi_line)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .json(path)
    )
    source = F.col("_metadata.file_path")
    return reports.select(*_of_run(source, run_pattern), "results", F.col("_broken").isNotNull().alias("broken"))


def read_build_reports(
    spark: SparkSession, path: str, run_pattern: str = RUN_PATTERN, multi_line: bool = True, glob: str = "*.json"
) -> DataFrame:
    """``(run_id, platform, label, success)`` of the reports that can be read."""
    return explode_results(read_report_files(spark, path, run_pattern, multi_line, glob).where("NOT broken").drop("broken"))


def read_runs(spark: SparkSession, path: str, run_pattern: str = RUN_PATTERN, glob: str = "*.json") -> DataFrame:
    """``(run_id, platform)`` of every report file, from the listing alone.

    A scan leaves out files without content, so the names come from the file index, which the driver
    holds for any scan of the folder.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    names = spark.createDataFrame([(name,) for name in listing.inputFiles()], "path STRING")
    return names.select(*_of_run(F.col("path"), run_pattern)).distinct()


def run_states(runs: DataFrame, reports: DataFrame, cancelled: DataFrame | None = None) -> DataFrame:
    """``(run_id, platform, state)``: each run is ``cancelled``, ``unreadable`` or ``read``.

    ``reports(run_id, platform, broken)`` has a row per report. A run is unreadable with a broken
    report or none; a cancelled run is that whatever its report is. A report without
    results, ``{}``, is read and has no failures.
    """
    keys = ["run_id", "platform"]
    told = reports.groupBy(*keys).agg(F.bool_or("broken").alias("broken"))
    states = runs.select(*keys).distinct().join(told, keys, "left")
    state = F.when(F.coalesce("broken", F.lit(True)), "unreadable").otherwise("read")
    if cancelled is not None:
        states = states.join(cancelled.select(*keys, F.lit(True).alias("cancelled")), keys, "left")
        state = F.when(F.col("cancelled"), "cancelled").otherwise(state)
    return states.select(*keys, state.alias("state"))


def stage_reports(reports: DataFrame, path: str) -> None:
    """Write reports as Parquet, one folder per platform, sorted by run.

    A hash of the label splits a run that holds most of the rows; unlike ranges it
    needs no sample, so unsplittable reports are parsed once. The order within a
    file leaves row groups that a filter on the run can skip.
    """
    (
        reports.repartition("platform", "run_id", F.pmod(F.xxhash64("label"), F.lit(64)))
        .sortWithinPartitions("platform", "run_id", "label")
        .write.mode("overwrite")
        .partitionBy("platform")
        .parquet(path)
    )


def read_known_failures(
    spark: SparkSession, path: str, platform_pattern: str = KNOWN_FAILURE_FILE, glob: str = KNOWN_FAILURE_GLOB
) -> DataFrame:
    """``(platform, label)``: entries of the list files, platform from the file's name or path; other files are not read."""
    lines = read_lines(spark, path, glob)
    return lines.where(is_entry(F.col("line"))).select(
        F.regexp_extract("path", platform_pattern, 1).alias("platform"), F.col("line").alias("label")
    )


def read_numbered_known_failures(spark: SparkSession, path: str) -> DataFrame:
    """``(platform, label, line_no)``, for reports that point at list lines."""
    lines = number_lines(read_texts(spark, path, KNOWN_FAILURE_GLOB))
    return lines.where(is_entry(F.col("line"))).select(
        F.regexp_extract("path", KNOWN_FAILURE_FILE, 1).alias("platform"), F.col("line").alias("label"), "line_no"
    )


def read_changed_paths(spark: SparkSession, path: str) -> DataFrame:
    """``(path)``: one changed path per line."""
    return read_lines(spark, path).where(F.col("line") != "").select(F.col("line").alias("path"))


def read_resolver_logs(spark: SparkSession, root: str, attempt_pattern: str = r"([^/]+)/([0-9]+)\.log$") -> DataFrame:
    """``(slot, round, line_no, line)`` of one file per resolve attempt."""
    lines = number_lines(read_texts(spark, root, "*.log"))
    return lines.select(
        F.regexp_extract("path", attempt_pattern, 1).alias("slot"),
        F.regexp_extract("path", attempt_pattern, 2).cast("int").alias("round"),
        "line_no",
        "line",
    )


def read_collection(spark: SparkSession, root: str, member_pattern: str = r"([^/]+)/(.+)$") -> DataFrame:
    """``(collection, crate, path, content_hash)`` of a tree with one folder per crate."""
    from .files import relative_path

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below: Column = relative_path(F.col("path"), root)
    return files.select(
        F.lit(root).alias("collection"),
        F.regexp_extract(below, member_pattern, 1).alias("crate"),
        F.regexp_extract(below, member_pattern, 2).alias("path"),
        F.sha2("content", 256).alias("content_hash"),
    ).where(F.col("crate") != "")
