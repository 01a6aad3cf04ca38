"""Comparing two sets in one shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apart(keys: Sequence[str]) -> Column:
    """A grouping column that only follows from ``keys``, for sides of a join.

    Rows grouped by exactly the keys they are joined on stay in place for the join.
    Adaptive execution can then not split a hot key of the other side, because it
    needs both sides straight from a shuffle. Grouped by this column too, they are
    shuffled once more by the join; after the grouping that is one row per key.
    """
    return F.xxhash64(*keys).alias("_apart")


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct ``keys`` as one side of a join whose other side may have hot keys."""
    return df.select(*keys, apart(keys)).distinct().drop("_apart")


def flag_groups(rows: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per key; each flag is true where it is true in any of the key's rows."""
    return rows.groupBy(*keys).agg(*[F.bool_or(name).alias(name) for name in names])


def membership(left: DataFrame, right: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Distinct keys of both sides, with a flag per side named by ``names``."""

    def flagged(df: DataFrame, here: str) -> DataFrame:
        return df.select(*keys, *[F.lit(name == here).alias(name) for name in names])

    return flag_groups(flagged(left, names[0]).unionByName(flagged(right, names[1])), keys, names)


def union_distinct(parts: Sequence[DataFrame]) -> DataFrame:
    """Set union."""
    return reduce(DataFrame.unionByName, parts).distinct()


def except_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """Set difference over all columns of ``left``."""
    keys = left.columns
    return membership(left, right, keys, ("in_left", "in_right")).where("in_left AND NOT in_right").select(*keys)
