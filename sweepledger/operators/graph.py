"""Dependency graphs: blast radius, exclusive claims, dangling labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .propagate import spread, spread_bits, spread_causes
from .setops import apart, membership

WORD = 62  # platforms in one number


def dependents_closure(
    edges: DataFrame, seeds: DataFrame, scope: Sequence[str] = (), max_rounds: int | None = None
) -> DataFrame:
    """Everything that transitively depends on a seed, seeds included.

    ``edges(src, dst)``: src depends on dst. ``seeds(node)``. Result ``(scope…,
    node, depth)`` with the least distance. Cycles are fine. If ``max_rounds`` is given
    and does not suffice, it is an error.
    """
    return spread(edges, seeds, scope, max_rounds)


def _platform_bits(named: Column, names: Sequence[Sequence[str]]) -> Column:
    """``array<struct<word, bits>>`` of the platforms that ``named`` may stand for; of all where it is null."""
    def bits(word: int, among: Column | None) -> Column:
        total = F.lit(0).cast("bigint")
        for at, of in enumerate(names[word * WORD : (word + 1) * WORD]):
            bit = F.lit(1 << at).cast("bigint")
            total = total + (bit if among is None else F.when(among.isin(*of), bit).otherwise(F.lit(0).cast("bigint")))
        return total

    words = range(-(-len(names) // WORD))
    entry = lambda w, among: F.struct(F.lit(w).alias("word"), bits(w, among).alias("bits"))
    every, some = (F.array(*[entry(w, among) for w in words]) for among in (None, named))
    return F.when(named.isNull(), every).otherwise(F.filter(some, lambda e: e["bits"] != 0))


def closure_by_platform(edges: DataFrame, seeds: DataFrame, platforms: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(platform, node, depth)``: what is broken on each platform, one pass for all.

    ``edges(src, dst, platform)``: a dependency, on one platform only unless ``platform`` is null. ``seeds(platform, node)``: a known
    failure and the platform of its list. ``platforms`` maps the lists' names to those that edges may call them by; its
    own name always counts. Sets of platforms are bits of a number, of as many numbers as it takes. Edges and seeds of a platform that
    is not listed hold nowhere; see ``unlisted_platforms``.
    """
    names = [(name, *others) for name, others in platforms.items()]
    gated = edges.select("src", "dst", F.inline(_platform_bits(F.col("platform"), names))).distinct()
    own = [(name,) for name in platforms]
    start = seeds.where("platform IS NOT NULL").select("node", F.inline(_platform_bits(F.col("platform"), own)))
    found = spread_bits(gated, start, ["word"])
    held = F.array(
        *[
            F.when((F.col("word") == at // WORD) & (F.col("bits").bitwiseAND(F.lit(1 << at % WORD)) != 0), F.lit(name))
            for at, name in enumerate(platforms)
        ]
    )
    return found.select(F.explode(F.array_compact(held)).alias("platform"), "node", "depth")


def unlisted_platforms(edges: DataFrame, seeds: DataFrame, platforms: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(platform, n_edges, n_seeds)`` of platforms that edges or seeds name and the caller does not."""
    known = {name for name, others in platforms.items() for name in (name, *others)}
    sides = edges.select("platform", F.lit(1).alias("e"), F.lit(0).alias("s")).unionByName(
        seeds.select("platform", F.lit(0).alias("e"), F.lit(1).alias("s"))
    )
    others = sides.where(F.col("platform").isNotNull() & ~F.col("platform").isin(*known) | F.col("platform").isNull() & (F.col("s") == 1))
    return others.groupBy("platform").agg(F.sum("e").alias("n_edges"), F.sum("s").alias("n_seeds"))


def causes_by_platform(edges: DataFrame, seeds: DataFrame, platforms: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(platform, node, depth, cause, via)``: each broken node with its nearest known failure and the dependency that leads
    to it, ties by name. Inputs as for ``closure_by_platform``; an edge of one name may hold on several platforms."""
    mine = [F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, (name, *others))).alias("as")) for name, others in platforms.items()]
    meant = F.transform(F.filter(F.array(*mine), lambda p: F.array_contains(p["as"], F.col("platform"))), lambda p: p["name"])
    everywhere = F.array(F.lit(None).cast("string"))
    on = F.when(F.col("platform").isNull(), everywhere).otherwise(meant)
    steps = edges.select("src", "dst", F.explode(on).alias("platform")).distinct()
    return spread_causes(steps, seeds.where(F.col("platform").isin(*platforms)), ["platform"])


def root_counts(causes: DataFrame, keys: Sequence[str] = ("platform",)) -> DataFrame:
    """``(keys…, cause, n_explained, deepest)``: how many broken nodes each known failure explains, itself not counted."""
    told = causes.groupBy(*keys, "cause")
    return told.agg(F.count_if(F.col("depth") > 0).alias("n_explained"), F.max("depth").alias("deepest"))


def dangling_labels(references: DataFrame, targets: DataFrame, keys: Sequence[str] = ("label",)) -> DataFrame:
    """Labels on one side only: ``dangling`` has no target, ``unreferenced`` no reference."""
    sides = membership(references, targets, keys, ("referenced", "defined")).where("referenced != defined")
    return sides.select(*keys, F.when(F.col("referenced"), "dangling").otherwise("unreferenced").alias("problem"))


def links_conflicts(packages: DataFrame, keys: Sequence[str] = ("rig", "links")) -> DataFrame:
    """``links`` keys claimed by more than one package version in one graph.

    ``packages`` has the keys, ``package`` and ``version``. Result: one row per
    claimant of a contested key, with ``n_claimants``. The claimants of a key are
    never gathered in one row.
    """
    claims = packages.where(F.col(keys[-1]).isNotNull()).select(*keys, "package", "version").distinct()
    counts = claims.groupBy(*keys, apart(keys)).agg(F.count("*").alias("n_claimants"))
    return claims.join(counts.where(F.col("n_claimants") > 1).drop("_apart"), list(keys))
