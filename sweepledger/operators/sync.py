"""Copying between collections of ``(crate, path, content_hash)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .setops import distinct_keys, membership

MEMBER = ("crate", "path", "content_hash")


def insert_if_absent(source: DataFrame, target: DataFrame) -> DataFrame:
    """The target with every source crate it has no member of; crates come whole."""
    held = distinct_keys(target, ["crate"])
    added = source.select(*MEMBER).join(held, "crate", "left_anti")
    return added.unionByName(target.select(*MEMBER))


def insert_status(source: DataFrame, target: DataFrame) -> DataFrame:
    """``Copied`` or ``Skipped`` per source crate."""
    crates = membership(source, target, ["crate"], ("in_source", "in_target")).where("in_source")
    return crates.select("crate", F.when(F.col("in_target"), "Skipped").otherwise("Copied").alias("status"))


def refresh_matched(source: DataFrame, target: DataFrame) -> DataFrame:
    """The target with the source's members of the crates it already has.

    The source replaces members at the same path and adds new ones; members only
    the target has stay. A path occurs once in a crate, so the outer join has no hot
    key, and each side is shuffled and sorted once for it.
    """
    wanted = source.select(*MEMBER).join(distinct_keys(target, ["crate"]), "crate", "left_semi")
    new = wanted.withColumnRenamed("content_hash", "new_hash")
    old = target.select("crate", "path", F.col("content_hash").alias("old_hash"))
    both = new.join(old, ["crate", "path"], "full_outer")
    return both.select("crate", "path", F.coalesce("new_hash", "old_hash").alias("content_hash"))


def refresh_status(source: DataFrame, target: DataFrame) -> DataFrame:
    """``Copied`` or ``NoSource`` per target crate."""
    crates = membership(source, target, ["crate"], ("in_source", "in_target")).where("in_target")
    return crates.select("crate", F.when(F.col("in_source"), "Copied").otherwise("NoSource").alias("status"))


def changed_members(wanted: DataFrame, target: DataFrame) -> DataFrame:
    """Members a target should have and has not, or with other content; none once they were copied."""
    return wanted.select(*MEMBER).join(target.select(*MEMBER).distinct(), list(MEMBER), "left_anti")
