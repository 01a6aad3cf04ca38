"""Dependency manifests across rigs and dated slots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed_values import BLAME_PATTERNS, EXACT_PINNED
from ..functions.versions import in_range, is_prerelease, requirement_range, version_key
from ..session import drop_stage, stage, stage_at
from .loglines import first_blame
from .propagate import RoundsExceeded, spread
from .setops import apart, distinct_keys


# Rounds kept as separate tables before they are written as one.
COMPACT_EVERY = 16
# Rows of a round that are broadcast at most.
BROADCAST_ROWS = 10_000


def float_deps(deps: DataFrame, skip: Sequence[str] = EXACT_PINNED) -> DataFrame:
    """Requirements any version meets: ``*``.

    Features stay when there are any, ``default_features`` only when exactly false;
    everything else, and the crates in ``skip``, goes.
    """
    others = [c for c in deps.columns if c not in ("version_req", "features", "default_features", "package")]
    kept = deps.where(~F.col("crate").isin(*skip)) if skip else deps
    return kept.select(
        *others,
        F.lit("*").alias("version_req"),
        F.when(F.size("features") > 0, F.col("features")).alias("features"),
        F.when(F.col("default_features").eqNullSafe(False), F.lit(False)).alias("default_features"),
    )


def manifest_line() -> Column:
    """A floated requirement as one line of a manifest."""
    names = F.array_join(F.transform("features", lambda f: F.concat(F.lit('"'), f, F.lit('"'))), ", ")
    parts = F.concat_ws(
        ", ",
        F.format_string('version = "%s"', F.col("version_req")),
        F.when(~F.col("default_features"), F.lit("default-features = false")),
        F.when(F.size("features") > 0, F.concat(F.lit("features = ["), names, F.lit("]"))),
    )
    is_plain = F.coalesce(F.size("features") < 1, F.lit(True)) & F.col("default_features").isNull()
    return F.when(is_plain, F.format_string('%s = "%s"', F.col("crate"), F.col("version_req"))).otherwise(
        F.format_string("%s = { %s }", F.col("crate"), parts)
    )


def manifest_lines(deps: DataFrame, keys: Sequence[str] = ("slot",)) -> DataFrame:
    """``(keys…, crate, line)``; order by keys and crate where it is written."""
    return deps.select(*keys, "crate", manifest_line().alias("line"))


def package_count(packages: DataFrame, keys: Sequence[str] = ("rig",)) -> DataFrame:
    return packages.groupBy(*keys).agg(F.count("*").alias("package_count"))


def _count_true(flags) -> Column:
    """How many of the flags hold, without a distinct count and its second shuffle."""
    return reduce(lambda a, b: a + b, [F.col(flag).cast("bigint") for flag in flags])


def slot_matrix(deps: DataFrame, slots: Sequence[str], main: str = "main") -> DataFrame:
    """Presence of each crate per slot, first slot, number of slots, absence from main.

    ``deps(rig, crate)`` holds slots and the main rig. One grouping: repeated rows
    collapse before the shuffle. Every crate comes out: ``in_other`` marks those of a rig that is neither main nor
    listed, or null. Absent from main does not mean pruned, since main changes after a slot is minted.
    """
    flags = {f"in_{slot}": slot for slot in sorted(slots)}
    present = deps.groupBy("crate").agg(
        *[F.bool_or(F.col("rig").eqNullSafe(slot)).alias(flag) for flag, slot in flags.items()],
        F.bool_or(~F.coalesce(F.col("rig").isin(*slots, main), F.lit(False))).alias("in_other"),
        (~F.bool_or(F.col("rig").eqNullSafe(main))).alias("absent_vs_main"),
    )
    first = F.coalesce(*[F.when(F.col(flag), F.lit(slot)) for flag, slot in flags.items()])
    return present.withColumns({"first_slot": first, "n_slots": _count_true(flags)})


def platform_matrix(known: DataFrame, platforms: Sequence[str]) -> DataFrame:
    """Presence of each known failure per platform, and on how many of these it fails.

    Every label comes out: ``on_other`` marks those of a platform that is not listed, or null.
    """
    flags = {f"on_{p}": p for p in platforms}
    present = known.groupBy("label").agg(
        *[F.bool_or(F.col("platform").eqNullSafe(p)).alias(flag) for flag, p in flags.items()],
        F.bool_or(~F.coalesce(F.col("platform").isin(*platforms), F.lit(False))).alias("on_other"),
    )
    counted = present.withColumn("n_platforms", _count_true(flags))
    return counted.withColumn("everywhere", F.col("n_platforms") == len(platforms))


def latest_by_slot(index: DataFrame, slots: Sequence[str] | None, keys: Sequence[str], order: Column) -> DataFrame:
    """For each key and slot the row with the highest ``order`` first seen by then.

    ``index.slot`` is the first slot a row is visible in; without ``slots`` those of the index count, found in the same job. Each (key, slot) is
    reduced to its best row before the shuffle; a running maximum over the few
    slots of a key follows, and each result holds until the key's next slot.
    """
    row = F.struct(order.alias("rank"), F.struct(*[c for c in index.columns if c not in (*keys, "slot")]).alias("row"))
    best = index.groupBy(*keys, "slot").agg(F.max(row).alias("best"))
    history = W.partitionBy(*keys).orderBy("slot")
    running = best.select(
        *keys,
        F.col("slot").alias("since"),
        F.lead("slot").over(history).alias("until"),
        F.max("best").over(history.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("best"),
    )
    if slots is None:
        slot_list = best.select("slot").distinct().agg(F.collect_list("slot")).scalar()  # one row per slot
    else:
        slot_list = F.array(*[F.lit(s) for s in slots])
    running = running.withColumn("_slots", slot_list)
    valid = F.filter("_slots", lambda s: (s >= F.col("since")) & (F.col("until").isNull() | (s < F.col("until"))))
    return running.select(*keys, F.explode(valid).alias("slot"), F.col("best.row.*"))


def era_latest(index: DataFrame, slots: Sequence[str]) -> DataFrame:
    """``(crate, slot, version)``: the highest version published by each slot.

    ``index(crate, version, slot, yanked)``, slot being the first that holds the
    row. Yanked and pre-release versions do not count.
    """
    offered = index.where(~F.col("yanked") & ~is_prerelease(F.col("version"))).select("crate", "version", "slot")
    return latest_by_slot(offered, slots, ["crate"], version_key(F.col("version")))


def with_range(requirements: DataFrame, column: str = "version_req") -> DataFrame:
    """Add ``lo, hi, read`` of a requirement text (see ``requirement_range``); each distinct text is compiled once."""
    others = requirements.select(F.col(column).alias("_text")).distinct()
    compiled = others.select("_text", requirement_range(F.col("_text")).alias("_range"))
    joined = requirements.join(compiled, F.col(column).eqNullSafe(F.col("_text")), "left")
    return joined.select(*requirements.columns, *[F.col(f"_range.{c}").alias(c) for c in ("lo", "hi", "read")])


def unread_requirements(requirements: DataFrame, keys: Sequence[str] = ("slot", "crate"), column: str = "version_req") -> DataFrame:
    """``(keys…, version_req)`` of texts that are not understood; no version meets them."""
    return with_range(requirements, column).where("NOT read").select(*keys, column).distinct()


def latest_in_range(index: DataFrame, requirements: DataFrame, slots: Sequence[str]) -> DataFrame:
    """``(slot, crate, version_req, version)``: of each requirement's crate the highest version published by each slot and inside the
    requirement's range.

    ``index(crate, version, slot, yanked)`` as for ``era_latest``; ``requirements(crate, version_req)``. Distinct ranges of a
    crate meet its versions, each at the first slot that holds it; a running maximum over the few slots follows. A requirement that
    no version meets gives no row.
    """
    offered = index.where(~F.col("yanked") & ~is_prerelease(F.col("version")))
    versions = offered.groupBy("crate", "version", apart(["crate", "version"])).agg(F.min("slot").alias("slot"))
    versions = versions.select("crate", "version", "slot", version_key(F.col("version")).alias("v"))
    ranges = with_range(requirements.select("crate", "version_req").distinct())
    met = ranges.join(versions, "crate").where(in_range(F.col("v"), F.col("lo"), F.col("hi")))
    found = met.select("crate", "version_req", "slot", "v", "version")
    return latest_by_slot(found, slots, ["crate", "version_req"], F.col("v")).select("slot", "crate", "version_req", "version")


# Pruning -----------------------------------------------------------------------


def direct_dep_guard(blamed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Blamed crates that are no direct dependency of their slot: the slot is in error."""
    return blamed.join(distinct_keys(manifest, ["slot", "crate"]), ["slot", "crate"], "left_anti")


def apply_blame(
    manifest: DataFrame, log: DataFrame, patterns: Sequence[str] = BLAME_PATTERNS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round of pruning by resolver logs, for all slots at once.

    ``manifest(slot, crate, …)``, ``log(slot, round, line_no, line)``. Returns the
    manifest without the blamed crates, the dropped ``(slot, round, crate)``, and
    the slots in error: ``unhandled`` where a log blames nobody, ``transitive``
    where it blames a crate that is no direct dependency.
    """
    blamed = first_blame(log, patterns=patterns)
    direct = distinct_keys(manifest, ["slot", "crate"])
    named = blamed.where(F.col("crate").isNotNull())
    dropped = named.join(direct, ["slot", "crate"], "left_semi").select("slot", "round", "crate")
    errors = (
        blamed.where(F.col("crate").isNull())
        .select("slot", "round", "crate", F.lit("unhandled").alias("error"))
        .unionByName(direct_dep_guard(named, manifest).select("slot", "round", "crate", F.lit("transitive").alias("error")))
    )
    kept = manifest.join(dropped, ["slot", "crate"], "left_anti")
    return kept, dropped, errors


def prune_to_consistent(
    members: DataFrame,
    requirements: DataFrame,
    conflicts: DataFrame | None = None,
    offered_features: DataFrame | None = None,
    max_rounds: int | None = None,
) -> DataFrame:
    """Members dropped until every remaining one has what it needs.

    ``members(slot, crate, available)``; ``requirements(slot, crate, needs[,
    feature])``; ``conflicts(slot, conflict_id, line_no, crate)`` names rivals of
    which one must go; ``offered_features(slot, crate, feature)``.

    Round 1 drops, per slot, members the index lacks (``absent``), members asked
    for a feature they do not offer (``feature``), and members that need a crate that is no
    member (``unmet``). Each later round drops the members that needed a crate
    dropped the round before. All drops of a round are made at once: their order does not matter.

    Only when a slot has come to rest are its conflicts judged: those of whose rivals none is gone. Of conflicts that share
    rivals the one with the smallest ``(line_no, crate, conflict_id)`` goes first, and its first rival by line and name is dropped, in the
    round after the slot's last; what needed it follows. That is repeated until no conflict has all its
    rivals left. A conflict with a rival that is no member, or with one rival only, is none.

    Returns ``(slot, crate, round)``. There is no limit to the rounds; where the caller
    sets ``max_rounds`` and they do not suffice, it is an error.
    Both tables are persisted while it runs, since each serves several tests.
    """
    shared = [df.persist(StorageLevel.MEMORY_AND_DISK) for df in (members, requirements)]
    try:
        return _prune(members, requirements, conflicts, offered_features, max_rounds)
    finally:
        for df in shared:
            df.unpersist()


def _prune(members, requirements, conflicts, offered_features, max_rounds) -> DataFrame:
    keys = ["slot", "crate"]
    alive = members.where("available").select(*keys)
    absent = members.where("NOT available").select(*keys, F.lit("absent").alias("reason"))
    needs = requirements.select("slot", "crate", F.col("needs"))
    unmet = needs.join(
        members.select("slot", F.col("crate").alias("needs")), ["slot", "needs"], "left_anti"
    ).select(*keys, F.lit("unmet").alias("reason"))
    first = absent.unionByName(unmet)
    if offered_features is not None:
        asked = requirements.where(F.col("feature").isNotNull()).select("slot", F.col("needs").alias("crate"), "feature")
        missing = asked.join(offered_features, ["slot", "crate", "feature"], "left_anti")
        first = first.unionByName(missing.select(*keys, F.lit("feature").alias("reason")))
    # A crate that is no member cannot be dropped; only members are seeds.
    seeds = first.join(members.select(*keys), keys, "left_semi").select("slot", F.col("crate").alias("node"))
    edges = needs.select("slot", F.col("crate").alias("src"), F.col("needs").alias("dst")).join(
        alive.select("slot", F.col("crate").alias("src")), ["slot", "src"], "left_semi"
    )
    found = spread(edges, seeds, ["slot"], None if max_rounds is None else max_rounds - 1)
    dropped = found.select("slot", F.col("node").alias("crate"), (F.col("depth") + 1).alias("round"))
    if conflicts is None:
        return dropped
    rivals = stage(_whole_conflicts(conflicts, members), "rivals")
    dropped = stage(dropped, "dropped")
    while True:
        picked = stage(_judged_conflicts(rivals, dropped), "picked")
        if picked.isEmpty():
            return dropped
        rested = dropped.groupBy("slot").agg(F.max("round").alias("before"))
        here = edges.join(dropped.select("slot", F.col("crate").alias("src")), ["slot", "src"], "left_anti")
        more = spread(here, picked.select("slot", F.col("crate").alias("node")), ["slot"])
        after = more.join(rested, "slot", "left").select(
            "slot", F.col("node").alias("crate"), (F.coalesce("before", F.lit(0)) + F.col("depth") + 1).alias("round")
        )
        dropped = stage(dropped.unionByName(after), "dropped")
        if max_rounds is not None and not dropped.where(F.col("round") > max_rounds).isEmpty():
            raise RoundsExceeded(f"not ended after {max_rounds} rounds")


def _whole_conflicts(conflicts: DataFrame, members: DataFrame) -> DataFrame:
    """``(slot, conflict_id, line_no, crate, n)`` of conflicts of ``n`` rivals, two or more, all of them members."""
    rivals = conflicts.groupBy("slot", "conflict_id", "crate").agg(F.min("line_no").alias("line_no"))
    held = rivals.join(distinct_keys(members, ["slot", "crate"]).withColumn("here", F.lit(True)), ["slot", "crate"], "left")
    counts = held.groupBy("slot", "conflict_id", apart(["slot", "conflict_id"])).agg(F.count("*").alias("n"), F.count("here").alias("n_here"))
    whole = counts.where("n > 1 AND n = n_here").select("slot", "conflict_id", "n")
    return rivals.join(whole, ["slot", "conflict_id"]).select("slot", "conflict_id", "line_no", "crate", "n")


def _judged_conflicts(rivals: DataFrame, dropped: DataFrame) -> DataFrame:
    """``(slot, crate)``: the rivals to drop now. A live conflict is judged if it comes first among all that share a rival with it."""
    group = ["slot", "conflict_id"]
    left = rivals.join(dropped.select("slot", "crate"), ["slot", "crate"], "left_anti")
    pick = F.min(F.struct("line_no", "crate")).alias("pick")
    live = left.groupBy(*group, "n").agg(F.count("*").alias("n_left"), pick).where("n = n_left")
    order = F.struct("pick.line_no", "pick.crate", "conflict_id").alias("order")
    ordered = left.join(live.select(*group, order, "pick"), group)
    first = ordered.groupBy("slot", "crate").agg(F.min("order").alias("first"))
    beaten = ordered.join(first, ["slot", "crate"]).where("first != order").select(*group)
    return live.join(distinct_keys(beaten, group), group, "left_anti").select("slot", F.col("pick.crate").alias("crate")).distinct()


def _side(rows: DataFrame, n: int | None = None) -> DataFrame:
    """A side of a join that is broadcast if ``n``, the most rows it may have, is small. Any other is shuffled, so that it does not
    pass through the driver in each of many rounds."""
    return F.broadcast(rows) if n is not None and n <= BROADCAST_ROWS else rows.hint("merge")


def prune_versions(candidates: DataFrame, requirements: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``(slot, crate, version, round)``: candidate versions that cannot be used, in the round in which they fall.

    ``candidates(slot, crate, version)``; ``requirements(slot, crate[, version], needs, version_req)``, of one version of a crate, or
    of all if there is no such column or it is null. A candidate falls when one of its requirements has no candidate left inside its range; a
    crate is lost when all its candidates are.

    Support is counted: of each distinct range the candidates inside it. In a round the candidates that fell
    take their support away from the ranges they are in, and the owners of ranges without support fall
    next. So the pairs of a range and a version are met once at the start and once per fallen
    version. Each round's tables are written to the shared folder; the driver sees one count per round and, as
    broadcasts, rounds of ``BROADCAST_ROWS`` at most.
    """
    spark = candidates.sparkSession
    key = ["slot", "crate", "version"]
    held = stage(candidates.select(*key).distinct().withColumn("v", version_key(F.col("version"))), "candidates")
    if "version" not in requirements.columns:
        requirements = requirements.withColumn("version", F.lit(None).cast("string"))
    asked = with_range(requirements.select("slot", "crate", "version", "needs", "version_req").distinct())
    asked = stage(asked.select("slot", "crate", "version", "needs", "lo", "hi").distinct(), "requirements")
    span = ["slot", "needs", "lo", "hi"]
    # A range is named by a number, since open bounds are null and nulls do not join.
    ranges = stage(asked.select(*span).distinct().withColumn("range", F.monotonically_increasing_id()), "spans")
    same = lambda a, b: (F.col(f"{a}.slot") == F.col(f"{b}.slot")) & (F.col(f"{a}.needs") == F.col(f"{b}.needs"))
    equal = same("a", "r") & F.col("a.lo").eqNullSafe(F.col("r.lo")) & F.col("a.hi").eqNullSafe(F.col("r.hi"))
    owners = stage(asked.alias("a").join(_side(ranges).alias("r"), equal).select("a.slot", "a.crate", "a.version", "range"), "owners")

    def support(of: DataFrame, n: int | None = None) -> DataFrame:
        inside = (F.col("c.slot") == F.col("r.slot")) & (F.col("c.crate") == F.col("r.needs")) & in_range(F.col("c.v"), F.col("r.lo"), F.col("r.hi"))
        return _side(of, n).alias("c").join(ranges.alias("r"), inside).groupBy("range").agg(F.count("*").alias("n"))

    full = stage(support(held), "support")
    failed, n_failed = ranges.select("range").join(_side(full), "range", "left_anti"), None
    fallen, losses, round_no, n_fallen = [], [], 0, 0
    while True:
        round_no += 1
        hit = stage(owners.join(_side(failed, n_failed), "range", "left_semi").select("slot", "crate", "version").distinct(), "hit")
        n_hit = hit.count()
        # A requirement of all versions of a crate, or of one.
        whole = hit.where("version IS NULL").select("slot", "crate").distinct()
        single = hit.where("version IS NOT NULL")
        down = held.join(_side(whole, n_hit), ["slot", "crate"], "left_semi").unionByName(held.join(_side(single, n_hit), key, "left_semi")).distinct()
        if fallen:
            before = reduce(DataFrame.unionByName, [old.select(*key) for old in fallen])
            down = down.join(_side(before, n_fallen), key, "left_anti")
        now, path = stage_at(down, "fallen")
        n_now = now.count()
        if not n_now:
            drop_stage(spark, path)
            break
        n_fallen += n_now
        if max_rounds is not None and round_no > max_rounds:
            raise RoundsExceeded(f"not ended after {max_rounds} rounds")
        fallen.append(now.withColumn("round", F.lit(round_no)))
        lost = stage(support(now, n_now), "losses")
        n_failed = lost.count()
        losses.append(lost)
        touched = reduce(DataFrame.unionByName, losses).join(_side(lost.select("range"), n_failed), "range", "left_semi")
        gone = touched.groupBy("range").agg(F.sum("n").alias("gone"))
        failed = full.join(_side(gone, n_failed), "range").where("gone = n").select("range")
        if len(fallen) > COMPACT_EVERY:
            fallen = [stage(reduce(DataFrame.unionByName, fallen), "fallen")]
            losses = [stage(reduce(DataFrame.unionByName, losses).groupBy("range").agg(F.sum("n").alias("n")), "losses")]
    nothing = held.where("false").select(*key, F.lit(0).alias("round"))
    return reduce(DataFrame.unionByName, [layer.select(*key, "round") for layer in fallen], nothing)


def lost_crates(candidates: DataFrame, fallen: DataFrame) -> DataFrame:
    """``(slot, crate, round)`` of crates whose every candidate fell, with the round of the last."""
    keys = ["slot", "crate"]
    gone = _side(fallen.select(*keys, "version"))
    left = candidates.select(*keys, "version").distinct().join(gone, [*keys, "version"], "left_anti")
    return fallen.groupBy(*keys, apart(keys)).agg(F.max("round").alias("round")).select(*keys, "round").join(
        _side(distinct_keys(left, keys)), keys, "left_anti"
    )


def prune_resolved(
    members: DataFrame,
    candidates: DataFrame,
    requirements: DataFrame,
    conflicts: DataFrame | None = None,
    offered_features: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Both prunings until neither drops more: dropped ``(slot, crate, round)`` and the candidates left, ``(slot, crate, version)``.

    ``members(slot, crate)``; the others as for ``prune_versions`` and ``prune_to_consistent``. Crates whose candidates all fell are
    absent from the second pruning, and what that drops takes its candidates from the first. Rounds go on from one pruning to the next.
    """
    keys = ["slot", "crate"]
    of_crates = requirements.where("version IS NULL") if "version" in requirements.columns else requirements
    asked = of_crates.select(*[c for c in ("slot", "crate", "needs", "feature") if c in of_crates.columns])
    left = stage(candidates.select(*keys, "version").distinct(), "left")
    members = stage(members.select(*keys).distinct(), "members")
    dropped, before = [], 0
    while True:
        fallen = stage(prune_versions(left, requirements), "fallen")
        left = stage(left.join(fallen.select(*keys, "version"), [*keys, "version"], "left_anti"), "left")
        before = max(before, fallen.agg(F.max("round")).first()[0] or 0)
        held = distinct_keys(left, keys).withColumn("available", F.lit(True))
        now = members
        for old in dropped:
            now = now.join(old.select(*keys), keys, "left_anti")
        state = now.join(held, keys, "left").withColumn("available", F.coalesce("available", F.lit(False)))
        new = prune_to_consistent(stage(state, "state"), asked, conflicts, offered_features)
        new = stage(new.withColumn("round", (F.col("round") + before).cast("int")), "dropped")
        if new.isEmpty():
            return reduce(DataFrame.unionByName, dropped, new), left
        dropped.append(new)
        before = new.agg(F.max("round")).first()[0]
        left = stage(left.join(new.select(*keys), keys, "left_anti"), "left")


def pruned_list(dropped: DataFrame) -> DataFrame:
    """``(slot, round, crate)`` of all dropped crates, once each; sorted by these columns they are in drop order."""
    return dropped.select("slot", "round", "crate").distinct()
