"""Gapless places of rows within groups, whatever the groups' sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .shared import fresh


def with_places(rows: DataFrame, groups: list[str], order: list[Column], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``name``, each row's place in its group from 0, and ``(*groups, n)``, the groups' sizes.

    A null group is a group. Rows are dealt by ranges of group and order, so a group of any size is spread over many tasks,
    and written once in that order; a row's place is its place within its range and the number of its group's
    rows in the ranges before. Rows that tie in ``order`` get places in no particular order.
    """
    at, part, low, before = fresh(rows, "at", "part", "low", "before")
    key = [F.col(g).asc_nulls_first() for g in groups] + order
    ranged = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    placed = stage(ranged.withColumn(at, F.monotonically_increasing_id()), "ranges")
    parted = placed.withColumn(part, F.shiftright(at, 33))
    counts = parted.groupBy(*groups, part).agg(F.count("*").alias("n"), F.min(at).alias(low))
    earlier = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(counts.withColumn(before, F.coalesce(F.sum("n").over(earlier), F.lit(0))), "range-starts")
    own = starts.select(*[F.col(g).alias(f"{low}_{g}") for g in groups], F.col(part).alias(f"{low}_{part}"), low, before)
    met = F.col(part) == F.col(f"{low}_{part}")
    for g in groups:
        met = met & F.col(g).eqNullSafe(F.col(f"{low}_{g}"))
    found = parted.join(own, met).select(*rows.columns, (F.col(before) + F.col(at) - F.col(low)).alias(name))
    return found, starts.groupBy(*groups).agg(F.sum("n").alias("n"))
