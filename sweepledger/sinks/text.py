"""Text outputs. Sorting happens here only, by range, so that it stays distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.manifests import manifest_lines


def label_lines(df: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels in order."""
    return df.select(label).distinct().orderBy(label)


def write_label_lines(df: DataFrame, path: str, label: str = "label") -> None:
    """One label per line; the part files in name order are the sorted list."""
    label_lines(df, label).write.mode("overwrite").text(path)


def arg_labels(df: DataFrame, group: Sequence[str], label: str = "label") -> DataFrame:
    """Distinct labels of each group, a row each, whatever the group's size."""
    return df.select(*group, label).distinct()


def write_arg_strings(df: DataFrame, path: str, group: Sequence[str], label: str = "label") -> None:
    """Argument strings: one folder per group, whose part files in name order hold its labels, sorted, a space after each.

    A large group is split by range over several tasks and files.
    """
    ordered = arg_labels(df, group, label).repartitionByRange(*group, label).sortWithinPartitions(*group, label)
    ordered.write.mode("overwrite").partitionBy(*group).option("lineSep", " ").text(path)


def write_manifests(deps: DataFrame, path: str, keys: Sequence[str] = ("slot",)) -> None:
    """Manifest lines sorted by crate, one folder per slot."""
    lines = manifest_lines(deps, keys).repartitionByRange(*keys, "crate").sortWithinPartitions(*keys, "crate")
    lines.select(*keys, "line").write.mode("overwrite").partitionBy(*keys).text(path)


def verdict_lines(verdicts: DataFrame, seen: DataFrame, classes: DataFrame | None, named: DataFrame | None = None) -> DataFrame:
    """The report as ordered lines: each run's verdict, its new failures, and the stale entries.

    ``seen`` are ``reconcile.judged`` rows, ``classes`` those of ``reconcile.stale_classes``: a stale entry is one line without a run,
    with the number of runs it is stale in, as long as it is not asked for by run; ``named`` has such rows of the runs asked for, ``(run_id,
    platform, label)``. So there are no more lines than runs, failures and entries, besides those asked for, and each
    label is a line of its own. Without ``classes``, only ``named`` has stale entries: give it those of all runs. Order by ``platform``, ``run_id``, ``part`` and ``label``.
    """

    def lines(rows: DataFrame, part: int, kind, run_id="run_id", label="label", known=None, n=None) -> DataFrame:
        none = F.lit(None)
        return rows.select(
            (F.col(run_id) if run_id else none.cast("string")).alias("run_id"),
            "platform",
            F.lit(part).alias("part"),
            kind.alias("kind"),
            (F.col(label) if label else none.cast("string")).alias("label"),
            (F.col(known) if known else none.cast("bigint")).alias("known_count"),
            (F.col(n) if n else none.cast("bigint")).alias("n_runs"),
        )

    report = lines(verdicts, 0, F.col("verdict"), label=None, known="known_count").unionByName(
        lines(seen.where("NOT listed"), 1, F.lit("new"))
    )
    if classes is not None:
        report = report.unionByName(lines(classes, 2, F.lit("stale"), run_id=None, n="n_stale"))
    return report if named is None else report.unionByName(lines(named, 2, F.lit("stale")))
