"""Run a job: ``python -m sweepledger <job> …``.

The exit code says what the job decided: 0 when all is well, 1 when it is not.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .fixed_values import MAIN_RIG
from .plans import jobs


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="sweepledger")
    names = root.add_subparsers(dest="job", required=True)

    sweep = names.add_parser("sweep", help="reconcile sweep reports with known failures")
    sweep.add_argument("--reports", required=True)
    sweep.add_argument("--known", required=True)
    sweep.add_argument("--logs")
    sweep.add_argument("--ci", action="store_true", help="stale entries fail")
    sweep.add_argument("--name-run", action="append", default=[], help="list this run's stale entries by name")
    sweep.add_argument("patterns", nargs="*", default=[f"//{MAIN_RIG}/..."])

    impact = names.add_parser("impact", help="labels a change hits")
    impact.add_argument("--changed", help="file of changed paths")
    impact.add_argument("--crates", nargs="*", default=[], help="changed crates by name")
    impact.add_argument("--rigs", nargs="*", default=[], help="changed rigs by name")
    impact.add_argument("--targets", required=True)
    impact.add_argument("--known", help="list of the platform that builds")
    impact.add_argument("--exact-name", action="append", default=[])

    matrix = names.add_parser("matrix", help="failures per platform, dependencies per slot")
    matrix.add_argument("--known", required=True)
    matrix.add_argument("--root", required=True)

    mint = names.add_parser("mint", help="manifests of dated slots")
    mint.add_argument("--root", required=True)
    mint.add_argument("--index", required=True)
    mint.add_argument("--requirements", required=True)
    mint.add_argument("--config", help="the index's JSON settings, which must name the usual host")
    mint.add_argument("--features", help="stored table (slot, crate, feature)")
    mint.add_argument("--conflicts", help="stored table (slot, conflict_id, line_no, crate)")
    mint.add_argument("--gaps", help="logs of the generator")
    mint.add_argument("slots", nargs="+")

    drift = names.add_parser("drift", help="committed against regenerated target files")
    drift.add_argument("--committed", required=True)
    drift.add_argument("--regenerated", required=True)
    drift.add_argument("--output", required=True, help="stored table (rig, line)")
    drift.add_argument("--runs", required=True, help="stored table (rig, tool_failed)")
    drift.add_argument("--no-check", action="store_true", help="what the tool writes and drift fail no rig")

    directives = names.add_parser("directives", help="directive files against what the rigs resolved")
    directives.add_argument("--root", required=True)
    directives.add_argument("--locks", required=True)
    directives.add_argument("platforms", nargs="+", help="name,os,arch,env")

    graph = names.add_parser("graph", help="what known failures break, dangling and contested labels")
    graph.add_argument("--root", required=True)
    graph.add_argument("--known", required=True)

    for name, text in (("extend", "copy crates the target lacks"), ("refresh", "refresh crates the target has")):
        sync = names.add_parser(name, help=text)
        sync.add_argument("source")
        sync.add_argument("target")
        sync.add_argument("--copy", action="store_true", help="copy the files, not only list them")

    for job in names.choices.values():
        job.add_argument("--out", required=True)
    return root


def main(argv: list[str] | None = None) -> int:
    given = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"sweepledger {given.job}").getOrCreate()
    if given.job == "sweep":
        row = jobs.sweep(spark, given.reports, given.known, given.out, given.patterns, given.logs, given.ci, given.name_run)
        failed = row["n_failed"] > 0
    elif given.job == "impact":
        row = jobs.impact(spark, given.changed, given.targets, given.known, given.out, given.exact_name, given.crates, given.rigs)
        failed = False
    elif given.job == "matrix":
        row = jobs.matrix(spark, given.known, given.root, given.out)
        failed = row["n_errors"] > 0
    elif given.job == "mint":
        more = (given.config, given.features, given.conflicts, given.gaps)
        row = jobs.mint(spark, given.root, given.slots, given.index, given.requirements, given.out, *more)
        failed = False
    elif given.job == "drift":
        output, runs = spark.read.parquet(given.output), spark.read.parquet(given.runs)
        row = jobs.drift(spark, given.committed, given.regenerated, output, runs, given.out, not given.no_check)
        failed = row["failed"]
    elif given.job == "directives":
        platforms = [tuple((p.split(",") + [""] * 3)[:4]) for p in given.platforms]
        row = jobs.directives(spark, given.root, given.locks, given.out, platforms)
        failed = row["n_unread"] + row["n_errors"] > 0
    elif given.job == "graph":
        row = jobs.graph(spark, given.root, given.known, given.out)
        failed = row["n_dangling"] + row["n_conflicts"] + row["n_errors"] > 0
    else:
        row = getattr(jobs, given.job)(spark, given.source, given.target, given.out, given.copy)
        failed = False
    print(row)
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
