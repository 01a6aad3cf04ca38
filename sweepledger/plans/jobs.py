"""The jobs over files: sweep, impact, matrix, mint, drift, directives, graph, extend, refresh.

Each reads its inputs, runs the operators over all runs, platforms, rigs and slots
at once, writes its outputs below ``out``, and returns the row that decides.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import (
    DIFF_LINES,
    DIRECTIVE_FILE,
    IMPACT_KINDS,
    IMPACT_PATTERNS,
    LINKS_VARIABLE,
    LOCK_FILE,
    MAIN_RIG,
    MANIFEST_FILE,
    PLATFORMS,
    SNAPSHOT_RIG,
    TARGET_FILE,
)
from ..functions.outcomes import index_is_faithful
from ..functions.versions import is_prerelease, version_key
from ..operators import drift as D
from ..operators import gates as V
from ..operators import graph as N
from ..operators import impact as I
from ..operators import loglines as G
from ..operators import manifests as M
from ..operators import reconcile as R
from ..operators import sync as S
from ..operators.setops import distinct_keys
from ..session import stage, tidy
from ..sinks import text as K
from ..sinks.files import copy_members
from ..sources import manifests as SM
from ..sources import sweeps as SS
from ..sources import targets as ST
from ..sources.files import read_lines, read_lines_in_order, read_texts, relative_path


@tidy
def sweep(
    spark: SparkSession,
    reports: str,
    known: str,
    out: str,
    patterns: Sequence[str] = (f"//{MAIN_RIG}/...",),
    logs: str | None = None,
    is_ci: bool = False,
    named: Sequence[str] = (),
) -> Row:
    """Reconcile every run with its platform's list; verdicts and report lines.

    A stale entry is one line for all runs, with their number; those of the runs in ``named`` are also listed by run.

    ``logs`` holds one file per run at the same place as its report. Every report file is a run and gets a
    verdict. A run whose log says that it was cancelled, or whose report cannot be read, is not reconciled: its
    verdict says so and counts as failed.
    """
    run_pattern = r"([^/]+)/([^/]+)/[^/]+\.{}$"
    at = run_pattern.format("json")
    parsed = SS.read_report_files(spark, reports, at)
    SS.stage_reports(SS.explode_results(parsed.where("NOT broken").drop("broken")), f"{out}/reports")
    cancelled = None
    if logs is not None:
        of = run_pattern.format("log")
        lines = read_lines(spark, logs).select(
            F.regexp_extract("path", of, 2).alias("run_id"), F.regexp_extract("path", of, 1).alias("platform"), "line"
        )
        cancelled = R.cancelled_runs(lines)
    # Whether a report has results is read too: the broken ones alone cannot be asked for.
    seen = parsed.select("run_id", "platform", "broken", F.col("results").isNull().alias("plain"))
    states = stage(SS.run_states(SS.read_runs(spark, reports, at), stage(seen, "read"), cancelled), "runs")
    runs = states.where("state = 'read'").drop("state")
    staged = spark.read.schema("run_id STRING, label STRING, success STRING, platform STRING").parquet(f"{out}/reports")
    observed = R.observed_failures(staged.join(runs, ["run_id", "platform"], "left_semi"))
    listed = R.scope_known(SS.read_known_failures(spark, known), patterns)
    others = states.where("state <> 'read'").withColumnRenamed("state", "verdict")
    seen = stage(R.judged(observed, listed), "judged")
    R.verdicts_of(seen, listed, runs, is_ci).unionByName(others, allowMissingColumns=True).write.mode("overwrite").parquet(
        f"{out}/verdicts"
    )
    verdicts = spark.read.parquet(f"{out}/verdicts")
    classes = R.stale_classes(seen, listed, runs)
    asked = R.stale_in_runs(seen, classes, runs.where(F.col("run_id").isin(*named))) if named else None
    lines = K.verdict_lines(verdicts, seen, classes, asked)
    lines.sort("platform", "run_id", "part", "label").write.mode("overwrite").parquet(f"{out}/lines")
    failed = F.col("verdict").isin("fail", "cancelled", "unreadable")
    return verdicts.agg(F.count("*").alias("n_runs"), F.count_if(failed).alias("n_failed")).first()


@tidy
def impact(
    spark: SparkSession,
    changed_paths: str | None,
    targets: str,
    known: str | None,
    out: str,
    exact_names: Sequence[str] = (),
    crates: Sequence[str] = (),
    rigs: Sequence[str] = (),
    patterns: Sequence[str] = IMPACT_PATTERNS,
) -> Row:
    """Labels to build for a change, and changed crates no target is named after.

    What changed are the paths in the file ``changed_paths``, the ``crates`` and ``rigs`` given by name, or all of these.
    ``targets`` is a stored ``(label, kind)`` table, of which ``patterns`` count: by default all but the snapshot rigs.
    ``known`` is the list of the platform that builds; without one, or where there is no such file, nothing is known to be broken.
    """
    paths = SS.read_changed_paths(spark, changed_paths) if changed_paths is not None else spark.createDataFrame([], "path STRING")
    changed = I.changed_crates(paths).union(spark.createDataFrame([(c,) for c in crates], "crate STRING")).distinct()
    hit_rigs = I.changed_rigs(paths).union(spark.createDataFrame([(r,) for r in rigs], "rig STRING")).distinct()
    universe = R.scope_known(I.of_kind(ST.read_targets(spark, targets), IMPACT_KINDS), patterns)
    hits = I.impact_of(changed, hit_rigs, universe, _known_or_none(spark, known), exact_names=exact_names)
    K.write_label_lines(hits, f"{out}/labels")
    skipped = I.unmatched_changes(changed, universe)
    K.write_label_lines(skipped, f"{out}/skipped", "crate")
    return spark.read.text(f"{out}/labels").agg(F.count("*").alias("n_labels")).first()


def _known_or_none(spark: SparkSession, known: str | None) -> DataFrame:
    """The list's entries; none if there is no list. Any other failure to read it is an error."""
    try:
        if known is not None:
            return SS.read_known_failures(spark, known)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], "platform STRING, label STRING")


@tidy
def matrix(
    spark: SparkSession, known: str, root: str, out: str, platforms: Sequence[str] = (), slots: Sequence[str] = ()
) -> Row:
    """Presence of known failures per platform and of direct dependencies per dated slot.

    ``known`` holds the lists, ``root`` the rigs with their manifests. Without ``platforms`` or ``slots`` all that have a list or
    a manifest get a column; otherwise the others are marked, not dropped. Writes ``platforms``, ``slots`` and ``errors`` (manifests that
    cannot be read).
    """
    listed = stage(SS.read_known_failures(spark, known), "known")
    deps = SM.read_manifest_deps(spark, root).select("rig", "crate")
    slot = F.regexp_extract("rig", SNAPSHOT_RIG, 1)
    deps = stage(deps.withColumn("rig", F.when(F.col("rig") == MAIN_RIG, "main").when(slot != "", slot).otherwise(F.col("rig"))), "deps")
    if not platforms:
        platforms = sorted(r[0] for r in listed.select("platform").distinct().collect())  # one per list
    if not slots:
        slots = sorted(r[0] for r in deps.where("rig != 'main' AND NOT contains(rig, '/')").select("rig").distinct().collect())  # one per snapshot
    M.platform_matrix(listed, platforms).write.mode("overwrite").parquet(f"{out}/platforms")
    M.slot_matrix(deps, slots).write.mode("overwrite").parquet(f"{out}/slots")
    SM.file_errors(spark, root, [MANIFEST_FILE]).write.mode("overwrite").parquet(f"{out}/errors")
    count = lambda name: spark.read.parquet(f"{out}/{name}").count()
    return Row(n_labels=count("platforms"), n_crates=count("slots"), n_errors=count("errors"))


@tidy
def mint(
    spark: SparkSession,
    root: str,
    slots: Sequence[str],
    index: str,
    requirements: str,
    out: str,
    config: str | None = None,
    features: str | None = None,
    conflicts: str | None = None,
    gaps: str | None = None,
) -> Row:
    """Manifests of dated slots: main's dependencies, floated, pruned, at their latest.

    ``index`` is a stored ``(crate, version, slot, yanked)`` table, slot being the
    first that has the version; ``requirements`` a stored ``(slot, crate, needs[, feature][, version, version_req])``,
    of direct and transitive crates; with ``version_req`` candidate versions are pruned too and the latest one left is locked. ``features``
    is a stored ``(slot, crate, feature)`` of what is offered, ``conflicts`` a stored ``(slot, conflict_id, line_no, crate)``. ``config`` is the
    index's JSON settings: if they do not name the usual host the index is refused, before anything is read from it. ``gaps`` holds the generator's
    logs, whose lines are written without their prefix. A manifest that cannot be read is an error: nothing would be minted from it.

    ``transitive`` lists crates that are at fault without being direct dependencies, which cannot be pruned from a manifest; the
    direct dependencies that need them are. ``unread`` lists requirement texts that are not understood, which nothing meets.
    """
    if config is not None:
        text = spark.read.text(config, wholetext=True).select(index_is_faithful(F.col("value")).alias("faithful"))
        if not all(r["faithful"] for r in text.collect()):  # one settings file
            raise ValueError(f"{config}: not a faithful copy of the index")
    broken = SM.file_errors(spark, f"{root}/{MAIN_RIG}", [MANIFEST_FILE]).where(F.col("source") == MANIFEST_FILE).collect()  # one file
    if broken:
        raise ValueError(f"{root}/{MAIN_RIG}/{MANIFEST_FILE}: {broken[0]['error']}")
    main = SM.read_manifest_deps(spark, root).where(F.col("rig") == MAIN_RIG)
    floated = stage(M.float_deps(main.drop("rig").withColumn("slot", F.explode(F.array(*[F.lit(s) for s in slots])))), "floated")
    needs = spark.read.parquet(requirements)
    offers = spark.read.parquet(features) if features is not None else None
    rivals = spark.read.parquet(conflicts) if conflicts is not None else None
    published = spark.read.parquet(index)
    ranged = "version_req" in needs.columns
    direct = floated.select("slot", "crate")
    if offers is not None:
        # The manifest itself asks for features too; it is named by an empty crate, which is no member.
        own = floated.select("slot", F.lit("").alias("crate"), F.col("crate").alias("needs"), F.explode("features").alias("feature"))
        needs = needs.unionByName(own, allowMissingColumns=True)
    if ranged:
        offered = published.where(~F.col("yanked") & ~is_prerelease(F.col("version")))
        later = F.filter(F.array(*[F.lit(s) for s in slots]), lambda s: s >= F.col("slot"))
        candidates = offered.select(F.explode(later).alias("slot"), "crate", "version").distinct()
        members = direct.unionByName(candidates.select("slot", "crate")).distinct()
        faulty, left = M.prune_resolved(members, candidates, needs, rivals, offers)
        newest = left.groupBy("slot", "crate").agg(F.max_by("version", version_key(F.col("version"))).alias("version"))
        M.unread_requirements(needs).write.mode("overwrite").parquet(f"{out}/unread")
    else:
        newest = M.era_latest(published, slots)
    latest = stage(newest, "latest")
    if not ranged:
        held = latest.select("slot", "crate", F.lit(True).alias("offered"))
        members = direct.join(held, ["slot", "crate"], "full_outer").select(
            "slot", "crate", F.coalesce("offered", F.lit(False)).alias("available")
        )
        faulty = M.prune_to_consistent(members, needs, rivals, offers)
    faulty = stage(faulty, "faulty")
    dropped = faulty.join(direct, ["slot", "crate"], "left_semi")
    M.direct_dep_guard(faulty, floated).write.mode("overwrite").parquet(f"{out}/transitive")
    kept = floated.join(dropped, ["slot", "crate"], "left_anti")
    K.write_manifests(kept, f"{out}/manifests")
    M.pruned_list(dropped).sort("slot", "round", "crate").write.mode("overwrite").parquet(f"{out}/pruned")
    kept.join(latest, ["slot", "crate"]).select("slot", "crate", "version").write.mode("overwrite").parquet(f"{out}/locks")
    if gaps is not None:
        told = read_lines_in_order(spark, gaps)
        G.gap_lines(told.select(F.col("path"), "line_no", "line")).sort("path", "line_no").write.mode("overwrite").parquet(f"{out}/gaps")
    counts = M.package_count(spark.read.parquet(f"{out}/locks"), ["slot"])
    counts.write.mode("overwrite").parquet(f"{out}/counts")
    total = spark.read.parquet(f"{out}/counts").agg(F.coalesce(F.sum("package_count"), F.lit(0)).alias("n_packages"))
    return total.first()


@tidy
def drift(
    spark: SparkSession, committed: str, regenerated: str, output: DataFrame, runs: DataFrame, out: str, check: bool = True
) -> Row:
    """Status of every rig, and the records that differ. Outside ``check`` mode output of the tool alone fails no rig.

    ``runs(rig, tool_failed)`` and ``output(rig, line)`` come from regenerating.
    """

    def files(root: str) -> DataFrame:
        texts = read_texts(spark, root, TARGET_FILE).select(relative_path(F.col("path"), root).alias("path"), "content")
        return texts.select(F.regexp_replace("path", f"/?{TARGET_FILE}$", "").alias("rig"), F.sha2("content", 256).alias("content_hash"))

    D.rig_status(runs, output, D.drift_of_files(files(committed), files(regenerated)), check).write.mode("overwrite").parquet(
        f"{out}/rigs"
    )
    # A map cannot be compared, so records are compared by their JSON. Each file is parsed once.
    before, after = [
        stage(ST.read_target_graph(spark, root).select("rig", "name", F.to_json(F.struct("*")).alias("record")), "targets")
        for root in (committed, regenerated)
    ]
    # Without a committed copy there is nothing a rig could have drifted from.
    after = after.join(distinct_keys(files(committed), ["rig"]), "rig", "left_semi")
    records = D.drift_records(before, after, ["rig", "name"], ["record"])
    records.write.mode("overwrite").parquet(f"{out}/records")
    ranked = G.head_lines(
        spark.read.parquet(f"{out}/records").select("rig", F.col("name").alias("line_no"), "change"), ["rig"], DIFF_LINES
    ).withColumnRenamed("line_no", "name")
    ranked.write.mode("overwrite").parquet(f"{out}/shown")
    return D.overall_status(spark.read.parquet(f"{out}/rigs")).first()


@tidy
def directives(
    spark: SparkSession, root: str, locks: str, out: str, platforms: Sequence[tuple[str, str, str, str]]
) -> Row:
    """Directives against what the rigs resolved.

    Reads directive files below ``root`` and locks below ``locks``. Writes ``effective`` (what is in force per
    rig, crate, version and platform), ``dead`` (gates no resolved version is in), ``uncovered`` (versions
    of gated crates that no exact gate covers), ``gaps`` and ``overlaps`` (of the version ranges of each crate's gates), ``shadowed``
    (sections that a later one overrules wherever they hold), ``unused`` (crates that no rig has) and ``unread`` (gates that are not
    understood) and ``errors`` (files that cannot be read; only these two fail the audit, the others are reports).
    """
    given = stage(SM.read_fixup_directives(spark, root), "directives")
    resolved = stage(SM.read_lock_packages(spark, locks), "resolved")
    keyed = V.with_version_key(resolved)
    ranges = stage(V.gate_ranges(given), "gates")
    alone = V.clause_table(given).where("read").groupBy("gate").agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("tests").alias("tests"))
    keyed_sections = given.where("key IS NOT NULL").select("rig_scope", "crate", "key", "section_no", "gate").distinct()
    sections = keyed_sections.join(alone, "gate", "left").where("gate IS NULL OR n = 1")
    sections = sections.withColumn("tests", F.to_json(F.sort_array(F.coalesce("tests", F.array().cast("array<struct<attr:string,value:string>>")))))
    tables = {
        "effective": V.effective_directives(given, resolved, platforms),
        "dead": V.dead_of_clauses(ranges, keyed),
        "uncovered": V.uncovered_versions(keyed, ranges.where("exact")),
        "gaps": V.coverage_gaps(ranges),
        "overlaps": V.coverage_overlaps(ranges),
        "shadowed": V.shadowed_sections(sections, ["rig_scope", "crate", "key", "tests"]),
        "unused": V.unused_fixups(given, resolved),
        "unread": V.unread_gates(given, ["rig_scope", "crate"]),
        "errors": SM.file_errors(spark, root, [DIRECTIVE_FILE]).unionByName(SM.file_errors(spark, locks, [LOCK_FILE])),
    }
    return _write_counted(spark, tables, out)


@tidy
def graph(
    spark: SparkSession, root: str, known: str, out: str, platforms: Mapping[str, Sequence[str]] | None = None
) -> Row:
    """The dependency graph of all target files below ``root``.

    Writes ``broken`` (per platform all targets that depend on a known failure of its list, with the least distance), ``causes`` (the nearest
    such failure of each and the dependency towards it), ``roots`` (how many targets each failure explains), ``unlisted`` (platforms that lists
    or dependencies name and ``platforms`` does not; by default the lists' own ones with their usual names), ``dangling`` (dependencies without a target), ``unreferenced`` (targets nothing depends on) and ``conflicts`` (native
    libraries that several package versions of a rig claim) and ``errors`` (target files that cannot be read).
    """
    targets = stage(ST.read_target_graph(spark, root), "targets")
    edges = stage(ST.target_edges(targets), "edges")
    seeds = stage(SS.read_known_failures(spark, known).select("platform", F.col("label").alias("node")), "seeds")
    if platforms is None:
        lists = [r["platform"] for r in seeds.select("platform").distinct().collect()]  # one per list file
        platforms = {p: PLATFORMS.get(p, ()) for p in sorted(lists)} or PLATFORMS
    causes = stage(N.causes_by_platform(edges, seeds, platforms), "causes")
    claims = targets.select(
        "rig", F.col("env")[LINKS_VARIABLE].alias("links"), F.coalesce("crate", "name").alias("package"), "version"
    )
    sides = stage(N.dangling_labels(edges.select(F.col("dst").alias("label")), targets.select("label")), "sides")
    sides.where("problem = 'unreferenced'").write.mode("overwrite").parquet(f"{out}/unreferenced")
    tables = {
        "broken": N.closure_by_platform(edges, seeds, platforms),
        "causes": causes,
        "roots": N.root_counts(causes),
        "unlisted": N.unlisted_platforms(edges, seeds, platforms),
        "dangling": sides.where("problem = 'dangling'").select("label"),
        "conflicts": N.links_conflicts(claims),
        "errors": ST.file_errors(spark, root),
    }
    return _write_counted(spark, tables, out)


def _write_counted(spark: SparkSession, tables: dict[str, DataFrame], out: str) -> Row:
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{out}/{name}")
    return Row(**{f"n_{name}": spark.read.schema(rows.schema).parquet(f"{out}/{name}").count() for name, rows in tables.items()})


@tidy
def extend(spark: SparkSession, source: str, target: str, out: str, copy: bool = False) -> Row:
    """Members the target has after every crate it lacks was copied; status per crate. With ``copy`` the files are copied too."""
    return _sync(spark, source, target, out, S.insert_if_absent, S.insert_status, copy)


@tidy
def refresh(spark: SparkSession, source: str, target: str, out: str, copy: bool = False) -> Row:
    """Members the target has after its own crates were refreshed; status per crate. With ``copy`` the files are copied too."""
    return _sync(spark, source, target, out, S.refresh_matched, S.refresh_status, copy)


def _sync(spark: SparkSession, source: str, target: str, out: str, members, status, copy: bool) -> Row:
    # Read before anything is copied, so that all tables tell of the same state.
    sides = [stage(SS.read_collection(spark, root), "collection") for root in (source, target)]
    wanted = stage(members(*sides), "members")
    wanted.write.mode("overwrite").parquet(f"{out}/members")
    status(*sides).write.mode("overwrite").parquet(f"{out}/status")
    if copy:
        copy_members(S.changed_members(wanted, sides[1]), source, target).write.mode("overwrite").parquet(f"{out}/copied")
    return spark.read.parquet(f"{out}/status").agg(F.count_if(F.col("status") == "Copied").alias("n_copied")).first()
