"""What a change hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import IMPACT_KINDS, KIND_PREFIX, LABEL_CELL, RIG_FIXUP_PATH, RIG_OF_FIXUP_PATH, SHARED_FIXUP_PATH
from ..functions import labels as L
from .setops import distinct_keys, union_distinct


def of_kind(targets: DataFrame, kinds: Sequence[str] = IMPACT_KINDS) -> DataFrame:
    """Targets of the given kinds, bare or qualified; a plain ``IN``, so it reaches the scan."""
    return targets.where(F.col("kind").isin(*kinds, *[f"{KIND_PREFIX}{kind}" for kind in kinds]))


def changed_crates(paths: DataFrame, shared: str = SHARED_FIXUP_PATH, local: str = RIG_FIXUP_PATH) -> DataFrame:
    """Distinct crates whose shared or rig-local directives changed."""
    crate = L.changed_crate(F.col("path"), shared, local)
    return paths.select(crate.alias("crate")).where(F.col("crate").isNotNull()).distinct()


def changed_rigs(paths: DataFrame, pattern: str = RIG_OF_FIXUP_PATH) -> DataFrame:
    rig = L.changed_rig(F.col("path"), pattern)
    return paths.select(rig.alias("rig")).where(F.col("rig").isNotNull()).distinct()


def _by_match_name(targets: DataFrame) -> DataFrame:
    return targets.select("label", F.explode(L.match_names(L.name_of(F.col("label")))).alias("crate"))


def impacted_targets(changed: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets named as a changed crate, with or without a version suffix."""
    crates = distinct_keys(changed, ["crate"])
    return _by_match_name(targets).join(crates, "crate", "left_semi").select("label").distinct()


def impacted_rigs(rigs: DataFrame, targets: DataFrame, cell: str = LABEL_CELL) -> DataFrame:
    """Every target whose package is exactly a changed rig."""
    packages = rigs.select(F.concat(F.lit(f"{cell}//"), "rig").alias("package"))
    by_package = targets.select("label", L.package_of(F.col("label")).alias("package"))
    return by_package.join(packages, "package", "left_semi").select("label").distinct()


def drop_known_broken(candidates: DataFrame, known: DataFrame, exact_names: Sequence[str] = ()) -> DataFrame:
    """Candidates whose stem is not the stem of a known failure in the same package."""
    stems = distinct_keys(known.select(L.stem(F.col("label"), exact_names).alias("stem_label")), ["stem_label"])
    return (
        candidates.withColumn("stem_label", L.stem(F.col("label"), exact_names))
        .join(stems, "stem_label", "left_anti")
        .drop("stem_label")
    )


def unmatched_changes(changed: DataFrame, targets: DataFrame) -> DataFrame:
    """Changed crates no target is named after; they are reported as skipped."""
    return changed.join(distinct_keys(_by_match_name(targets), ["crate"]), "crate", "left_anti")


def impact_of(
    crates: DataFrame, rigs: DataFrame, targets: DataFrame, known: DataFrame, cell: str = LABEL_CELL, exact_names: Sequence[str] = ()
) -> DataFrame:
    """Labels to build for changed ``(crate)`` and ``(rig)``, less known-broken ones."""
    hits = union_distinct([impacted_targets(crates, targets), impacted_rigs(rigs, targets, cell)])
    return drop_known_broken(hits, known, exact_names)


def change_impact(
    paths: DataFrame,
    targets: DataFrame,
    known: DataFrame,
    cell: str = LABEL_CELL,
    exact_names: Sequence[str] = (),
) -> DataFrame:
    """Labels to build for changed paths: hit by crate or by rig, less known-broken ones."""
    return impact_of(changed_crates(paths), changed_rigs(paths), targets, known, cell, exact_names)
