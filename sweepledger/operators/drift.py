"""Committed output against regenerated output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drift_records(
    committed: DataFrame, regenerated: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Records that differ: ``added``, ``removed`` or ``changed`` per key.

    Keys are unique on each side, so the full outer join has no hot key. ``values``
    are compared themselves, nulls as values.
    """
    old = committed.select(*keys, F.struct(*values).alias("old"))
    new = regenerated.select(*keys, F.struct(*values).alias("new"))
    change = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    )
    pairs = old.join(new, list(keys), "full_outer").withColumn("change", change)
    return pairs.where(F.col("change").isNotNull())


def drift_of_files(committed: DataFrame, regenerated: DataFrame) -> DataFrame:
    """``(rig, status)`` by digest: ``same``, ``stale``, or ``new`` with nothing committed.

    ``(rig, content_hash)`` on both sides. A rig without a committed copy passes.
    """
    both = regenerated.select("rig", F.col("content_hash").alias("made")).join(
        committed.select("rig", F.col("content_hash").alias("kept")), "rig", "left"
    )
    status = F.when(F.col("kept").isNull(), "new").when(F.col("kept") == F.col("made"), "same").otherwise("stale")
    return both.select("rig", status.alias("status"))


def drift_counts(records: DataFrame, keys: Sequence[str] = ("rig",)) -> DataFrame:
    return records.groupBy(*keys).agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")]
    )


def rig_status(runs: DataFrame, output: DataFrame, drifted: DataFrame, check: bool = True) -> DataFrame:
    """``(rig, failed, reason)``: the tool failed, it wrote anything in check mode, or drift.

    ``runs(rig, tool_failed)``, ``output(rig, line)``, ``drifted(rig, status)``.
    Every rig is judged by itself.
    """
    spoke = output.where(F.col("line") != "").select("rig", F.lit(True).alias("spoke")).distinct()
    stale = drifted.where(F.col("status") == "stale").select("rig", F.lit(True).alias("stale")).distinct()
    judged = runs.join(spoke, "rig", "left").join(stale, "rig", "left")
    reason = F.when(F.col("tool_failed"), "tool failed")
    if check:
        reason = reason.when(F.col("spoke"), "not clean").when(F.col("stale"), "stale")
    return judged.select("rig", reason.isNotNull().alias("failed"), reason.alias("reason"))


def overall_status(statuses: DataFrame) -> DataFrame:
    """One row: how many rigs there are and whether any failed."""
    return statuses.agg(
        F.count("*").alias("n_rigs"),
        F.count_if("failed").alias("n_failed"),
        F.coalesce(F.bool_or("failed"), F.lit(False)).alias("failed"),
    )
