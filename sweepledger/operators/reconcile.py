"""Observed failures against known failures, in both directions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import LABEL_CELL
from ..functions.labels import in_scope, package_of, scope_key, strip_config
from ..functions.outcomes import not_success
from ..functions.lines import is_cancel_notice
from .setops import distinct_keys, flag_groups, membership

KEYS = ("platform", "label")
RUN = ("run_id", "platform")


def observed_failures(reports: DataFrame) -> DataFrame:
    """Failed rows of build reports, labels without their configuration."""
    return reports.where(not_success(F.col("success"))).withColumn("label", strip_config(F.col("label"))).drop("success")


def cancelled_runs(logs: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Runs whose log says that the build was cancelled."""
    return distinct_keys(logs.where(is_cancel_notice(F.col("line"))), keys)


def drop_cancelled(reports: DataFrame, logs: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Reports without cancelled runs: those would name targets that were never built."""
    return reports.join(cancelled_runs(logs, keys), list(keys), "left_anti")


def scope_known(known: DataFrame, patterns: Sequence[str], cell: str = LABEL_CELL) -> DataFrame:
    """Known failures a sweep of ``patterns`` could have seen.

    Only known failures are scoped; what was observed is scoped by what was built.
    """
    return known.where(in_scope(F.col("label"), patterns, cell))


def scope_to(labels: DataFrame, patterns: DataFrame, cell: str = LABEL_CELL) -> DataFrame:
    """As ``scope_known`` for a table of patterns of any size, ``(pattern)``.

    Each package is unfolded into its ancestors and equi-joined with the patterns,
    instead of testing every label against every pattern.
    """
    keys = patterns.select(scope_key(F.col("pattern"), cell).alias("scope_key")).distinct()

    package = F.col("scope_package")
    parts = F.split(F.regexp_replace(package, F.lit(r"^\Q" + cell + r"//\E"), F.lit("")), "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.concat(F.lit(f"below {cell}//"), F.array_join(F.slice(parts, F.lit(1), n), "/")),
    )
    package_keys = F.array_union(
        ancestors, F.array(F.lit(f"below {cell}/"), F.concat(F.lit("package "), package))
    )
    with_package = labels.withColumn("scope_package", package_of(F.col("label")))
    packages = (
        with_package.select("scope_package")
        .distinct()
        .withColumn("scope_key", F.explode(package_keys))
        .join(keys, "scope_key", "left_semi")
    )
    packages = distinct_keys(packages, ["scope_package"]).withColumn("package_in", F.lit(True))
    single = keys.where(F.col("scope_key").startswith("target ")).select(
        F.substr("scope_key", F.lit(len("target ") + 1)).alias("label"), F.lit(True).alias("label_in")
    )
    return (
        with_package.join(packages, "scope_package", "left")
        .join(single, "label", "left")
        .where(F.coalesce("package_in", F.lit(False)) | F.coalesce("label_in", F.lit(False)))
        .select(*labels.columns)
    )


def reconcile(observed: DataFrame, known: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Status of every label on either side: ``new``, ``stale`` or ``known``."""
    return _with_status(membership(observed, known, keys, ("seen", "listed")), keys)


def reconcile_flagged(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """As ``reconcile`` where both sides come from one table, ``(keys…, seen, listed)``.

    The table is read once; a row says whether it counts as observed, as known, or
    both. Keys that are neither do not come out.
    """
    return _with_status(flag_groups(rows.where("seen OR listed"), keys, ("seen", "listed")), keys)


def _with_status(flags: DataFrame, keys: Sequence[str]) -> DataFrame:
    status = F.when(F.col("seen") & F.col("listed"), "known").when(F.col("seen"), "new").otherwise("stale")
    return flags.select(*keys, status.alias("status"))


def new_failures(observed: DataFrame, known: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return reconcile(observed, known, keys).where(F.col("status") == "new").drop("status")


def stale_entries(observed: DataFrame, known: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return reconcile(observed, known, keys).where(F.col("status") == "stale").drop("status")


def judged(observed: DataFrame, known: DataFrame) -> DataFrame:
    """``(run_id, platform, label, listed)``: each failure of a run once, and whether its platform's list has it.

    Verdicts and report lines both follow from this table; write it once where both are wanted.
    """
    listed = distinct_keys(known, KEYS).withColumn("listed", F.lit(True))
    seen = observed.select(*RUN, "label").distinct().join(listed, list(KEYS), "left")
    return seen.withColumn("listed", F.coalesce("listed", F.lit(False)))


def stale_classes(seen: DataFrame, known: DataFrame, runs: DataFrame) -> DataFrame:
    """``(platform, label, n_runs, n_stale)``: entries some run of their platform did not fail on, of how many runs, in how many.

    One row per entry, however many runs there are: an entry is stale in all runs but those that ``judged``
    rows name. Entries of platforms without a run are stale nowhere.
    """
    hits = seen.where("listed").groupBy(*KEYS).agg(F.count("*").alias("n_seen"))
    entries = known.select(*KEYS, F.lit(0).cast("bigint").alias("n_seen")).unionByName(hits).groupBy(*KEYS).agg(F.sum("n_seen").alias("n_seen"))
    per_platform = runs.select(*RUN).distinct().groupBy("platform").agg(F.count("*").alias("n_runs"))
    counted = entries.join(per_platform, "platform").withColumn("n_stale", F.col("n_runs") - F.col("n_seen"))
    return counted.where("n_stale > 0").select(*KEYS, "n_runs", "n_stale")


def stale_in_runs(seen: DataFrame, classes: DataFrame, runs: DataFrame) -> DataFrame:
    """``(run_id, platform, label)`` of stale entries, one row per entry and run, for the few ``runs`` that are asked for."""
    pairs = runs.select(*RUN).distinct().join(classes.select(*KEYS), "platform")
    return pairs.join(seen.where("listed").select(*RUN, "label"), [*RUN, "label"], "left_anti")


def stale_per_run(observed: DataFrame, known: DataFrame, runs: DataFrame) -> DataFrame:
    """``(run_id, platform, label)`` of the stale entries of all ``runs``, one row per run and entry.

    An entry meets the runs that failed on it once and gives a row for each other run of its platform, so what is
    shuffled grows with the failures and the lists; only the result has a row per run and entry. Null runs and labels are values like others.
    """
    run = F.struct("run_id")
    sides = known.select(*KEYS, F.lit(True).alias("listed"), F.lit(None).cast("struct<run_id:string>").alias("run")).unionByName(
        observed.select(*KEYS, F.lit(False).alias("listed"), run.alias("run"))
    )
    hits = sides.groupBy(*KEYS).agg(F.bool_or("listed").alias("listed"), F.collect_set("run").alias("hits"))
    per_platform = runs.select(*RUN).groupBy("platform").agg(F.collect_set(run).alias("runs"))
    others = F.inline(F.array_except("runs", "hits"))
    return hits.where("listed").join(per_platform, "platform").select(others, *KEYS)


def target_count(targets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Targets in scope, per ``keys`` or over all."""
    return targets.where(F.col("label") != "").groupBy(*keys).agg(F.count("*").alias("target_count"))


def known_count(known: DataFrame, keys: Sequence[str] = ("platform",)) -> DataFrame:
    return known.select(*keys, "label").distinct().groupBy(*keys).agg(F.count("*").alias("known_count"))


def verdicts(statuses: DataFrame, keys: Sequence[str], is_ci: bool) -> DataFrame:
    """Counts and outcome per group of ``reconcile`` rows.

    New failures always fail. Stale entries fail in CI and only warn elsewhere,
    where a machine may have packages the runners lack.
    """
    counts = statuses.groupBy(*keys).agg(
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("new", "stale", "known")]
    )
    return _decide(counts.withColumn("known_count", F.col("known_count") + F.col("stale_count")), is_ci)


def run_verdicts(observed: DataFrame, known: DataFrame, runs: DataFrame, is_ci: bool) -> DataFrame:
    """One verdict per run, for any number of runs and platforms. Runs without failures get one too."""
    return verdicts_of(judged(observed, known), known, runs, is_ci)


def verdicts_of(seen: DataFrame, known: DataFrame, runs: DataFrame, is_ci: bool) -> DataFrame:
    """As ``run_verdicts``, from ``judged`` rows. Stale entries are counted as the list's size less the entries
    seen, so the list is never copied per run."""
    told = seen.groupBy(*RUN).agg(
        F.count_if(~F.col("listed")).alias("new_count"), F.count_if(F.col("listed")).alias("matched_count")
    )
    counts = (
        runs.select(*RUN)
        .distinct()
        .join(told, list(RUN), "left")
        .join(known_count(known), "platform", "left")
        .fillna(0, ["new_count", "matched_count", "known_count"])
    )
    stale = F.col("known_count") - F.col("matched_count")
    return _decide(counts.withColumn("stale_count", stale).drop("matched_count"), is_ci)


def _decide(counts: DataFrame, is_ci: bool) -> DataFrame:
    has_new, has_stale = F.col("new_count") > 0, F.col("stale_count") > 0
    failed = has_new | has_stale if is_ci else has_new
    verdict = F.when(failed, "fail").when(has_stale, "warn").otherwise("ok")
    return counts.withColumn("verdict", verdict)
