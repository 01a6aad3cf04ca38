"""Version- and platform-gated directives against resolved packages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clauses import CLAUSES, read_clauses
from ..functions.versions import in_range, parse_version_gate, requirement_range, version_key, within
from .setops import distinct_keys

BOUNDS = ("lo", "hi", "hi_inc")


def with_bounds(directives: DataFrame) -> DataFrame:
    """Add ``lo, hi, hi_inc, exact, version_only`` from the ``gate`` text.

    Rows whose gate tests no version get open bounds.
    """
    parsed = directives.withColumn("_bounds", parse_version_gate(F.col("gate")))
    return parsed.select(
        *directives.columns,
        *[F.col(f"_bounds.{b}").alias(b) for b in ("lo", "hi")],
        *[F.coalesce(F.col(f"_bounds.{b}"), F.lit(False)).alias(b) for b in ("hi_inc", "exact", "version_only")],
    )


def clause_table(gates: DataFrame) -> DataFrame:
    """``(gate, clause, read, lo, hi, exact, tests)``: each distinct gate as alternatives of which one must hold.

    Of a clause, ``lo`` and ``hi`` are the half-open range of all its version tests together (see
    ``versions.requirement_range``), ``exact`` whether one of them is of the form ``=a``, and ``tests`` its platform tests, ``(attr, value)``. A
    gate that is not understood, or a version text in it, has ``read`` false and holds nowhere; a gate without any alternative has
    no row.
    """
    rows = gates.select("gate").where("gate IS NOT NULL").distinct().mapInPandas(read_clauses, CLAUSES)
    texts = F.transform(F.filter("tests", lambda t: t["attr"] == "version"), lambda t: t["value"])
    whole = requirement_range(F.array_join(texts, ","))
    is_exact = F.exists(texts, lambda t: t.rlike(r"^\s*=[^,]*$"))
    platform = F.filter("tests", lambda t: t["attr"] != "version")
    told = rows.select("gate", "clause", "read", whole.alias("range"), F.coalesce(is_exact, F.lit(False)).alias("exact"), platform.alias("tests"))
    understood = F.col("read") & F.coalesce("range.read", F.lit(False))
    return told.select("gate", "clause", understood.alias("read"), "range.lo", "range.hi", "exact", "tests")


def platform_attributes(platforms: Sequence[tuple[str, str, str, str]], spark) -> DataFrame:
    """``(platform, attr, value)`` of ``(name, os, arch, env)``; what is missing is an empty text."""
    names = ("target_os", "target_arch", "target_env")
    rows = [(name, attr, value or "") for name, *values in platforms for attr, value in zip(names, values)]
    return spark.createDataFrame(rows, "platform STRING, attr STRING, value STRING")


def clause_platforms(clauses: DataFrame, attributes: DataFrame) -> DataFrame:
    """``(gate, clause, platform, lo, hi)``: where the platform tests of a clause all hold, by counting those met.

    ``clauses`` are ``clause_table`` rows, ``attributes(platform, attr, value)`` what is true of each platform.
    """
    known = clauses.where("read").select("gate", "clause", "lo", "hi", "tests", F.size("tests").alias("n"))
    tests = known.where("n > 0").select("gate", "clause", "n", F.inline("tests"))
    facts = attributes.select("platform", "attr", "value").distinct()
    met = tests.join(facts, ["attr", "value"]).groupBy("gate", "clause", "platform", "n").agg(F.count("*").alias("met"))
    holding = met.where("met = n").select("gate", "clause", "platform")
    ranges = known.select("gate", "clause", "lo", "hi")
    # A clause without platform tests holds on every platform: an equi-join on a constant of both sides would pair them
    # in one task, so its row has no platform instead.
    anywhere = known.where("n = 0").select("gate", "clause", F.lit(None).cast("string").alias("platform"), "lo", "hi")
    return holding.join(ranges, ["gate", "clause"]).select("gate", "clause", "platform", "lo", "hi").unionByName(anywhere)


def holding(rows: DataFrame, where: DataFrame) -> DataFrame:
    """``rows(gate, platform, v, …)`` whose gate holds; those without a gate always do.

    ``where`` are ``clause_platforms`` rows. A row comes out once, however many clauses hold: ranges of a gate on a platform are gathered
    first, and gates have few.
    """
    spans = where.groupBy("gate", "platform").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    there = spans.where("platform IS NOT NULL").withColumnRenamed("spans", "here")
    anywhere = spans.where("platform IS NULL").select("gate", F.col("spans").alias("anywhere"))
    found = rows.join(there, ["gate", "platform"], "left").join(anywhere, "gate", "left")
    none = F.array().cast("array<struct<lo:array<bigint>,hi:array<bigint>>>")
    every = F.concat(F.coalesce("here", none), F.coalesce("anywhere", none))
    inside = F.exists(every, lambda s: in_range(F.col("v"), s["lo"], s["hi"]))
    return found.where(F.col("gate").isNull() | inside).select(*rows.columns)


def with_version_key(resolved: DataFrame) -> DataFrame:
    return resolved.withColumn("v", version_key(F.col("version")))


def _hit(resolved: DataFrame, gates: DataFrame, key: str) -> Column:
    return (resolved[key] == gates[key]) & within(resolved["v"], gates["lo"], gates["hi"], gates["hi_inc"])


def gate_matches(resolved: DataFrame, gates: DataFrame, key: str = "crate") -> DataFrame:
    """Resolved rows with each gate of their crate that their version ``v`` is in.

    Equi-join on the crate with the range as a residual, so a crate with many
    resolved rows can be split among tasks.
    """
    joined = resolved.join(gates, _hit(resolved, gates, key))
    return joined.select(*[resolved[c] for c in resolved.columns], *[gates[c] for c in gates.columns if c != key])


def _versions(resolved: DataFrame, key: str, once: bool) -> DataFrame:
    """Distinct ``(key, v)``. Spark hashes these wide rows before and after the shuffle, which rows that are
    distinct already need not go through; ``once`` says so."""
    versions = resolved.select(key, "v")
    return versions if once else versions.distinct()


def dead_gates(gates: DataFrame, resolved: DataFrame, key: str = "crate", once: bool = False) -> DataFrame:
    """Gates no resolved version is in. They are allowed, and reported.

    ``once`` tells that ``resolved`` has each ``(key, v)`` in one row only.
    """
    versions = _versions(resolved, key, once)
    return gates.join(versions, _hit(versions, gates, key), "left_anti")


def uncovered_versions(resolved: DataFrame, gates: DataFrame, key: str = "crate", once: bool = False, many: bool = False) -> DataFrame:
    """Resolved versions no gate covers, of crates that are gated at all.

    Give it the exact gates only to find versions that need a section of their own. ``once`` tells that ``resolved`` has each
    ``(key, v)`` in one row only, ``many`` that there are more gates than each task should hold, however small their files are.
    """
    keys = distinct_keys(gates, [key])
    if many:
        keys, gates = keys.hint("merge"), gates.hint("merge")
    gated = _versions(resolved, key, once).join(keys, key, "left_semi")
    return gated.join(gates, _hit(gated, gates, key), "left_anti")


def resolve_override(directives: DataFrame, resolved: DataFrame) -> DataFrame:
    """Directives in force per rig: a rig's own file replaces the shared one whole.

    ``directives(rig_scope, crate, …)``, shared rows with an empty ``rig_scope``;
    ``resolved(rig, crate, …)`` says which rig has which crate. Each resolved row
    first learns whether its rig has an own file, from the keys of the local rows
    alone, and then looks up that file or the shared one by ``(rig_scope, crate)``:
    two equi-joins, and no group is gathered. Result: all columns of ``resolved``
    and of ``directives``.
    """
    local = directives.where(F.col("rig_scope") != "").select(F.col("rig_scope").alias("rig"), "crate")
    own = distinct_keys(local, ["rig", "crate"]).withColumn("has_own", F.lit(True))
    scope = F.when(F.col("has_own"), F.col("rig")).otherwise("")
    lookups = resolved.distinct().join(own, ["rig", "crate"], "left").withColumn("rig_scope", scope).drop("has_own")
    return lookups.join(directives, ["rig_scope", "crate"])


def last_wins(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The value of the last row by ``order`` for each key; partial results meet, no sort."""
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return rows.groupBy(*keys).agg(F.max_by(value, position).alias(value))


def effective_directives(
    directives: DataFrame, resolved: DataFrame, platforms: Sequence[tuple[str, str, str, str]]
) -> DataFrame:
    """``(rig, crate, version, platform, key, value_json)`` in force.

    ``platforms`` lists ``(name, os, arch, env)``. The base section applies first,
    then each gated section that holds, in order; the last one wins per key, for
    arrays and maps too. Overrides are resolved first. Gates may hold any number of version and platform tests; each distinct one
    is read once, as clauses.
    """
    spark = directives.sparkSession
    where = clause_platforms(clause_table(directives), platform_attributes(platforms, spark))
    names = F.explode(F.array(*[F.lit(p[0]) for p in platforms])).alias("platform")
    sections = resolve_override(directives, with_version_key(resolved.select("rig", "crate", "version")))
    sections = sections.where(F.col("key").isNotNull()).select("*", names)
    in_force = holding(sections, where)
    return last_wins(in_force, ["rig", "crate", "version", "platform", "key"], "value_json", ["section_no"])


def unread_gates(directives: DataFrame, keys: Sequence[str] = ("crate",)) -> DataFrame:
    """``(keys…, gate)`` of gates that are not understood, or a version text in them; they never hold, and are to be reported."""
    bad = clause_table(directives).where("NOT read")
    return directives.select(*keys, "gate").distinct().join(distinct_keys(bad, ["gate"]), "gate", "left_semi").select(*keys, "gate")


def gate_ranges(directives: DataFrame, key: str = "crate") -> DataFrame:
    """``(crate, gate, clause, lo, hi, hi_inc, exact)``: the version ranges that the gates of each crate test, one row per clause."""
    clauses = clause_table(directives).where("read AND (lo IS NOT NULL OR hi IS NOT NULL)")
    gated = directives.where("gate IS NOT NULL").select(key, "gate").distinct()
    return gated.join(clauses, "gate").select(key, "gate", "clause", "lo", "hi", F.lit(False).alias("hi_inc"), "exact")


def dead_of_clauses(ranges: DataFrame, resolved: DataFrame, key: str = "crate") -> DataFrame:
    """``(crate, gate)`` of ``gate_ranges`` rows no range of which holds a resolved version."""
    dead = dead_gates(ranges, resolved, key).groupBy(key, "gate").agg(F.count("*").alias("dead"))
    return ranges.groupBy(key, "gate").agg(F.count("*").alias("n")).join(dead, [key, "gate"]).where("dead = n").select(key, "gate")


def _spans(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct ranges with open bounds as the least and the greatest version; empty ones are left out."""
    bottom, top = F.array(*[F.lit(0).cast("bigint")] * 3), F.array(F.lit(2**63 - 1))
    return ranges.select(*keys, F.coalesce("lo", bottom).alias("lo"), F.coalesce("hi", top).alias("hi")).where("lo < hi").distinct()


def _ordered_ranges(ranges: DataFrame, key: str) -> DataFrame:
    """Distinct ranges of each crate from the lowest on, with the highest bound reached before."""
    before = W.partitionBy(key).orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    return _spans(ranges, [key]).withColumn("reached", F.max("hi").over(before))


def coverage_gaps(ranges: DataFrame, key: str = "crate") -> DataFrame:
    """``(crate, lo, hi)``: half-open ranges of versions between a crate's gates that none of them is for.

    Ranges are merged by a running maximum of their upper bounds. What lies below the lowest or above the highest gate is no gap. A
    window holds the distinct ranges of one crate.
    """
    return _ordered_ranges(ranges, key).where("reached < lo").select(key, F.col("reached").alias("lo"), F.col("lo").alias("hi"))


def coverage_overlaps(ranges: DataFrame, key: str = "crate") -> DataFrame:
    """``(crate, lo, hi)``: what a range of a crate shares with different ranges that begin before it, or where it does; ``hi`` is null where
    that is open. One row per such range."""
    shared = _ordered_ranges(ranges, key).where("reached > lo")
    return shared.select(key, "lo", F.nullif(F.least("reached", "hi"), F.array(F.lit(2**63 - 1))).alias("hi"))


def shadowed_sections(sections: DataFrame, keys: Sequence[str] = ("crate", "key")) -> DataFrame:
    """``(keys…, section_no)`` of sections that never have the last word: one later section of the same ``keys`` spans their whole range.

    ``sections(keys…, section_no, lo, hi)`` are version ranges, null where open, of sections that otherwise hold alike; put
    what else they test into the keys. A semi-join on the keys with the range as a residual, so no pairs come out.
    """
    own = _spans(sections, [*keys, "section_no"]).alias("a")
    later = own.alias("b")
    spans = (F.col("b.section_no") > F.col("a.section_no")) & (F.col("b.lo") <= F.col("a.lo")) & (F.col("b.hi") >= F.col("a.hi"))
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    return own.join(later, same & spans, "left_semi").select(*keys, "section_no").distinct()


def unused_fixups(fixups: DataFrame, resolved: DataFrame, key: str = "crate") -> DataFrame:
    """Crates with directives that no rig resolves: ignored, not an error."""
    return fixups.select(key).distinct().join(distinct_keys(resolved, [key]), key, "left_anti")


def gate_straddle(hits: DataFrame, keys: Sequence[str] = ("crate", "gate")) -> DataFrame:
    """Slots in which a gate turns on or off: it is tested on both sides there.

    ``hits(keys…, slot, hit)``. One row per key and slot remains before the window,
    so a window partition holds no more rows than there are slots.
    """
    per_slot = hits.groupBy(*keys, "slot").agg(F.bool_or("hit").alias("hit"))
    before = F.lag("hit").over(W.partitionBy(*keys).orderBy("slot"))
    return (
        per_slot.withColumn("was_hit", before)
        .where(F.col("was_hit").isNotNull() & (F.col("hit") != F.col("was_hit")))
        .select(*keys, "slot", "was_hit", "hit")
    )
