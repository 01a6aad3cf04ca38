"""Spreading along edges until nothing new is reached."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import drop_stage, stage_at
from .setops import except_distinct

# Keys of a frontier or of candidates are broadcast up to this many bytes, so that a round shuffles neither the
# edges nor the nodes seen. Each is measured as it is written; larger ones are shuffled.
BROADCAST_BYTES = 32 * 1024 * 1024
# Rounds kept as separate tables before they are written as one.
COMPACT_EVERY = 16


class RoundsExceeded(ValueError):
    """The rounds allowed by the caller did not suffice."""


class _Table:
    """A table written once to the shared folder, with its rows and the bytes of its keys, counted on the way."""

    def __init__(self, df: DataFrame, keys: Sequence[str], name: str):
        width = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) + 16 for k in keys])
        seen = Observation()
        counted = df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes"))
        self.rows, self.path = stage_at(counted, name)
        self.n, self.bytes = seen.get["n"], seen.get["bytes"]

    def is_small(self) -> bool:
        return self.bytes <= BROADCAST_BYTES

    def drop(self) -> None:
        drop_stage(self.rows.sparkSession, self.path)


def spread(
    edges: DataFrame,
    seeds: DataFrame,
    scope: Sequence[str] = (),
    max_rounds: int | None = None,
) -> DataFrame:
    """Nodes that reach a seed along ``src -> dst`` edges, with the least number of steps.

    ``edges`` has ``src``, ``dst`` and the ``scope`` columns, ``seeds`` has ``node``
    and the same scope columns; edges never leave their scope. A null ``src`` is a node like any other, a null ``dst`` is none. Returns ``(scope…,
    node, depth)``, seeds at depth 0. Every node enters the frontier once, so cycles end
    too. Rounds are not limited; a ``max_rounds`` that does not suffice raises ``RoundsExceeded``.

    Per round one join of the frontier with the edges (a hot ``dst`` is split by
    adaptive execution, or met by a broadcast frontier) gives candidates. While all nodes seen are
    small, by their measured bytes, they are broadcast to these. Later the distinct candidates are
    written and measured: small ones are looked up among the nodes seen where those lie; only large ones
    are compared with them in a shuffle. The two edge columns are persisted for the
    rounds and recomputed from their source where an executor is lost; each round's tables
    lie in the shared folder, so a loss costs a round at most.
    """
    keys = [*scope, "node"]
    steps = edges.select(*scope, F.col("src").alias("next"), F.col("dst").alias("node"))
    steps = steps.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _spread(steps, seeds.select(*keys).distinct(), keys, scope, max_rounds)
    finally:
        steps.unpersist()


def _spread(steps, seeds, keys, scope, max_rounds) -> DataFrame:
    frontier = _Table(seeds.withColumn("depth", F.lit(0)), keys, "frontier")
    layers, depth = [frontier], 0
    while frontier.n:
        seen = reduce(DataFrame.union, [layer.rows for layer in layers])
        reached = steps.join(_keys(frontier, keys), keys).select(*scope, F.col("next").alias("node"))
        if sum(layer.bytes for layer in layers) <= BROADCAST_BYTES:
            fresh = _matched(reached, F.broadcast(seen.select(*keys)), keys, "left_anti").distinct()
            new = _Table(fresh.withColumn("depth", F.lit(depth + 1)), keys, "frontier")
        else:
            candidates = _Table(reached.distinct(), keys, "candidates")
            fresh = _unseen(candidates, seen.select(*keys), keys).withColumn("depth", F.lit(depth + 1))
            new = _Table(fresh, keys, "frontier")
            candidates.drop()
        if new.n and max_rounds is not None and depth >= max_rounds:
            raise RoundsExceeded(f"not ended after {max_rounds} rounds")
        frontier, depth = new, depth + 1
        layers.append(new)
        if len(layers) > COMPACT_EVERY:
            # The new frontier stays as it is: the next round joins it.
            whole = _Table(seen, keys, "seen")
            for layer in layers[:-1]:
                layer.drop()
            layers = [whole, new]
    return reduce(DataFrame.union, [layer.rows for layer in layers])


def _keys(found: _Table, keys: Sequence[str]) -> DataFrame:
    return F.broadcast(found.rows.select(*keys)) if found.is_small() else found.rows.select(*keys)


def _matched(rows: DataFrame, others: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A join on keys of which null is one like any other, as in groupings, so that results do not depend on which of them is used."""
    named = others.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return rows.join(named, same, how)


def _unseen(candidates: _Table, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates that were not seen."""
    if not candidates.is_small():
        return except_distinct(candidates.rows, seen)
    met = _matched(seen, F.broadcast(candidates.rows), keys, "left_semi")
    return _matched(candidates.rows, F.broadcast(met), keys, "left_anti")


def spread_bits(edges: DataFrame, seeds: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Nodes that reach a seed along edges that hold under some conditions, for all conditions at once.

    ``edges(src, dst, bits)`` and ``seeds(node, bits)`` carry sets of up to 63 conditions as bits of a number, beside the ``scope``
    columns. Returns ``(scope…, node, bits, depth)``: the conditions under which a node first reaches a seed in ``depth`` steps;
    a node has a row per such depth. A node enters the frontier again with new bits only, so cycles
    end and one pass serves all conditions. Null nodes are as in ``spread``.

    Candidates are reduced to one row per node before they meet the nodes seen, which are broadcast while
    they are small by their measured bytes, else grouped with the candidates in a shuffle.
    """
    keys = [*scope, "node"]
    steps = edges.select(*scope, F.col("src").alias("next"), F.col("dst").alias("node"), F.col("bits").alias("on"))
    steps = steps.where("on != 0").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        start = seeds.groupBy(*keys).agg(F.bit_or("bits").alias("bits")).where("bits != 0").withColumn("depth", F.lit(0))
        frontier = _Table(start, keys, "frontier")
        layers, depth = [frontier], 0
        while frontier.n:
            now = frontier.rows.select(*keys, "bits")
            met = steps.join(F.broadcast(now) if frontier.is_small() else now, keys)
            reached = met.select(*scope, F.col("next").alias("node"), F.col("bits").bitwiseAND(F.col("on")).alias("bits"))
            reached = reached.where("bits != 0").groupBy(*keys).agg(F.bit_or("bits").alias("bits"))
            seen = reduce(DataFrame.union, [layer.rows.select(*keys, "bits") for layer in layers])
            new = _new_bits(reached, seen, keys, small=sum(layer.bytes for layer in layers) <= BROADCAST_BYTES)
            depth += 1
            frontier = _Table(new.withColumn("depth", F.lit(depth)), keys, "frontier")
            layers.append(frontier)
            if len(layers) > COMPACT_EVERY:
                whole = _Table(reduce(DataFrame.union, [layer.rows for layer in layers[:-1]]), keys, "seen")
                for layer in layers[:-1]:
                    layer.drop()
                layers = [whole, frontier]
        return reduce(DataFrame.union, [layer.rows for layer in layers])
    finally:
        steps.unpersist()


def _new_bits(reached: DataFrame, seen: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """``reached`` without the bits seen before, and without nodes that have none left."""
    if small:
        held = seen.groupBy(*keys).agg(F.bit_or("bits").alias("held")).select(*[F.col(k).alias(f"_{k}") for k in keys], "held")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        both = reached.join(F.broadcast(held), same, "left").withColumn("held", F.coalesce("held", F.lit(0)))
    else:
        none = F.lit(0).cast("bigint")
        sides = reached.select(*keys, "bits", none.alias("held")).unionByName(seen.select(*keys, none.alias("bits"), F.col("bits").alias("held")))
        both = sides.groupBy(*keys).agg(F.bit_or("bits").alias("bits"), F.bit_or("held").alias("held"))
    fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.col("held")))
    return both.select(*keys, fresh.alias("bits")).where("bits != 0")


def spread_causes(edges: DataFrame, seeds: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Nodes that reach a seed, each with its nearest seed and the step towards it.

    ``edges(src, dst)`` and ``seeds(node)`` with the ``scope`` columns; an edge whose scope is null holds in every scope. Returns
    ``(scope…, node, depth, cause, via)``: ``cause`` is the nearest seed, ``via`` the next node on the way to it, null for seeds. Of several
    nearest ones the smallest ``(cause, via)`` counts, by values. Null nodes do not take part.

    All ways of the least length come from the round before, so a node is settled when it is first reached.
    """
    keys = [*scope, "node"]
    steps = edges.select(*[F.col(s).alias(f"of_{s}") for s in scope], F.col("src").alias("next"), F.col("dst").alias("to"))
    steps = steps.where("next IS NOT NULL AND to IS NOT NULL").persist(StorageLevel.MEMORY_AND_DISK)
    same = reduce(lambda a, b: a & b, [F.col("to") == F.col("node"), *[F.col(f"of_{s}").isNull() | (F.col(f"of_{s}") == F.col(s)) for s in scope]])
    try:
        nothing = F.lit(None).cast(seeds.schema["node"].dataType)
        start = seeds.select(*keys).where("node IS NOT NULL").distinct()
        frontier = _Table(start.select(*keys, F.lit(0).alias("depth"), F.col("node").alias("cause"), nothing.alias("via")), keys, "frontier")
        layers, depth = [frontier], 0
        while frontier.n:
            now = frontier.rows.select(*keys, "cause")
            met = steps.join(F.broadcast(now) if frontier.is_small() else now, same)
            ways = met.select(*scope, F.col("next"), "cause", F.col("node").alias("via")).withColumnRenamed("next", "node")
            best = ways.groupBy(*keys).agg(F.min(F.struct("cause", "via")).alias("way"))
            seen = reduce(DataFrame.union, [layer.rows.select(*keys) for layer in layers])
            if sum(layer.bytes for layer in layers) <= BROADCAST_BYTES:
                fresh = _matched(best, F.broadcast(seen), keys, "left_anti")
            else:
                fresh = _matched(best, seen, keys, "left_anti")
            depth += 1
            frontier = _Table(fresh.select(*keys, F.lit(depth).alias("depth"), "way.cause", "way.via"), keys, "frontier")
            layers.append(frontier)
            if len(layers) > COMPACT_EVERY:
                whole = _Table(reduce(DataFrame.union, [layer.rows for layer in layers[:-1]]), keys, "seen")
                for layer in layers[:-1]:
                    layer.drop()
                layers = [whole, frontier]
        return reduce(DataFrame.union, [layer.rows for layer in layers])
    finally:
        steps.unpersist()
