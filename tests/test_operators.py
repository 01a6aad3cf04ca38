"""Operators on small literal tables, and on random ones against brute force."""

import json
import random
import re

import pytest
from frames import as_set
from pyspark.sql import functions as F

from sweepledger.operators import drift as D
from sweepledger.operators import gates as V
from sweepledger.operators import graph as G
from sweepledger.operators import impact as I
from sweepledger.operators import loglines as LL
from sweepledger.operators import manifests as M
from sweepledger.operators import propagate as P
from sweepledger.operators import reconcile as R
from sweepledger.operators import setops as O
from sweepledger.operators import sync as S
from sweepledger.sinks import text as K


@pytest.fixture
def table(spark):
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)


# Reconciliation ------------------------------------------------------------------


def test_report_to_verdict(table):
    reports = table(
        "run_id STRING, platform STRING, label STRING, success STRING",
        ("1", "L", "fixups//a:x#lib", "SUCCESS"),
        ("1", "L", "fixups//a:y#bin", "FAIL"),
        ("1", "L", "fixups//a:y#lib", "FAIL"),
        ("1", "L", "fixups//a:z", None),
        ("2", "L", "fixups//a:w", "FAIL"),
        ("3", "L", "fixups//a:x", "SUCCESS"),
    )
    logs = table(
        "run_id STRING, platform STRING, line STRING",
        ("1", "L", "all is well"),
        ("2", "L", "oh: evaluation of this key was cancelled"),
    )
    known = table("platform STRING, label STRING", ("L", "fixups//a:y"), ("L", "fixups//a:y"), ("L", "fixups//a:v"), ("M", "fixups//a:q"))
    whole = R.drop_cancelled(reports, logs)
    observed = R.observed_failures(whole)
    runs = whole.select("run_id", "platform").distinct()
    seen = R.judged(observed, known)
    classes = R.stale_classes(seen, known, runs)
    stale = R.stale_in_runs(seen, classes, runs)
    statuses = seen.select(*stale.columns, F.when(F.col("listed"), "known").otherwise("new").alias("status")).unionByName(
        stale.withColumn("status", F.lit("stale"))
    )
    assert as_set(statuses) == {
        ("1", "L", "fixups//a:y", "known"),
        ("1", "L", "fixups//a:z", "new"),
        ("1", "L", "fixups//a:v", "stale"),
        ("3", "L", "fixups//a:y", "stale"),
        ("3", "L", "fixups//a:v", "stale"),
    }
    columns = ("run_id", "new_count", "stale_count", "known_count", "verdict")
    for is_ci, verdict in ((True, "fail"), (False, "warn")):
        verdicts = R.run_verdicts(observed, known, runs, is_ci).select(*columns)
        assert as_set(verdicts) == {("1", 1, 1, 2, "fail"), ("3", 0, 2, 2, verdict)}
        assert as_set(R.verdicts(statuses, ["run_id"], is_ci).select(*columns)) == as_set(verdicts)
    assert as_set(classes) == {("L", "fixups//a:v", 2, 2), ("L", "fixups//a:y", 2, 1)}
    verdicts = R.run_verdicts(observed, known, runs, True)
    report = K.verdict_lines(verdicts, seen, classes, stale.where("run_id = '1'"))
    lines = [(r["kind"], r["label"], r["known_count"]) for r in report.where("run_id = '1'").orderBy("part", "label").collect()]
    assert lines == [("fail", None, 2), ("new", "fixups//a:z", None), ("stale", "fixups//a:v", None)]
    shared = K.verdict_lines(verdicts, seen, classes).where("run_id IS NULL").select("platform", "kind", "label", "n_runs")
    assert as_set(shared) == {("L", "stale", "fixups//a:v", 2), ("L", "stale", "fixups//a:y", 1)}


def test_each_run_names_its_stale_entries(spark):
    rng = random.Random(11)
    runs = [(r, p) for r in ("1", "2", "3", None) for p in "LM"]
    observed = [(*rng.choice(runs), rng.choice(["a", "b", "c", "d", None])) for _ in range(12)]
    known = [(rng.choice("LMN"), rng.choice(["a", "b", "c", None])) for _ in range(12)]
    stale = R.stale_per_run(
        spark.createDataFrame(observed, "run_id STRING, platform STRING, label STRING"),
        spark.createDataFrame(known, "platform STRING, label STRING"),
        spark.createDataFrame(runs * 2, "run_id STRING, platform STRING"),
    )
    got = [tuple(r) for r in stale.collect()]
    assert len(got) == len(set(got)) and set(got) == {(r, p, k) for r, p in runs for q, k in known if p == q} - set(observed)


def test_verdict_lines_have_a_row_per_run_and_stale_entry(spark, tmp_path):
    from sweepledger.plans.catalog import AUDITS

    parts = [(k, "red bolt", "PROMO", 5, "Brand#1") for k in (1, 2)]
    spark.createDataFrame(parts, "p_partkey LONG, p_name STRING, p_type STRING, p_size INT, p_brand STRING").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(1, s, "F", flag, day) for s, flag, day in (
        (1, "A", "1995-03-01"), (2, "A", "1995-03-01"), (3, "R", "1995-03-01"), (1, "R", "1996-03-01"), (9, "N", "1997-03-01")
    )]
    made = spark.createDataFrame(lines, "l_partkey LONG, l_suppkey LONG, l_linestatus STRING, l_returnflag STRING, day STRING")
    made.withColumn("l_shipdate", F.to_timestamp_ntz("day")).write.parquet(f"{tmp_path}/lineitem.parquet")
    report = AUDITS["verdict_lines"](spark, str(tmp_path))
    name = "//promo:red_bolt-5-s"
    assert as_set(report.where("part > 0").select("run_id", "platform", "kind", "label")) == {
        ("1995", "F", "new", f"{name}3"), ("1995", "F", "stale", f"{name}1"), ("1995", "F", "stale", f"{name}2"),
        ("1996", "F", "stale", f"{name}2"), ("1997", "F", "stale", f"{name}1"), ("1997", "F", "stale", f"{name}2"),
    }
    assert report.count() == 9


def test_two_sided_sets_equal_brute_force(spark):
    rng = random.Random(7)
    for size in (0, 5, 400):
        observed = [("L", f"//p:{rng.randrange(40)}") for _ in range(size)]
        known = [("L", f"//p:{rng.randrange(40)}") for _ in range(size // 2)]
        o, k = (spark.createDataFrame(rows, "platform STRING, label STRING") for rows in (observed, known))
        assert as_set(R.new_failures(o, k)) == set(observed) - set(known)
        assert as_set(R.stale_entries(o, k)) == set(known) - set(observed)
        assert as_set(O.except_distinct(o, k)) == set(observed) - set(known)
        assert as_set(O.union_distinct([o, k])) == set(observed) | set(known)


def test_scope_by_table_equals_regular_expressions(table, spark):
    labels = [f"fixups//{p}:{n}" for p in ("a", "a/b", "ab", "a/b/c", "w.x", "") for n in ("x", "y-1", "x-2")]
    known = table("label STRING, why STRING", *[(label, "w") for label in labels])
    for patterns in (["//a/..."], ["//a:"], ["//a/b:", "//w.x"], ["//a/b:x", "//ab:y-1"], ["//..."], ["//none:"], ["//a", "//a:x"]):
        scoped = R.scope_to(known, table("pattern STRING", *[(p,) for p in patterns]))
        regexes = []
        for p in patterns:
            body = re.escape(p[2:].removesuffix("/...").rstrip(":"))
            if p.endswith("/...") or ":" not in p:
                regexes.append("^fixups//" + ("" if p == "//..." else body + "[/:]"))
            else:
                regexes.append("^fixups//" + body + (":" if p.endswith(":") else "$"))
        want = {(label, "w") for label in labels if any(re.search(r, label) for r in regexes)}
        assert as_set(scoped) == want, patterns
        assert as_set(R.scope_known(known, patterns)) == want, patterns


def test_observed_outside_the_scope_is_new(table):
    observed = table("label STRING", ("fixups//a:x",), ("fixups//b:y",))
    known = table("label STRING", ("fixups//a:x",), ("fixups//b:y",))
    scoped = R.scope_known(known, ["//a:"])
    assert as_set(R.reconcile(observed, scoped, ["label"])) == {("fixups//a:x", "known"), ("fixups//b:y", "new")}


def test_counts(table):
    targets = table("label STRING", ("a",), ("",), ("b",))
    assert as_set(R.target_count(targets)) == {(2,)}


# Impact ----------------------------------------------------------------------------

RIG = "third-party/conflict-rigs/sqlx"
TARGETS = [
    "fixups//third-party:serde",
    "fixups//third-party:serde-1",
    "fixups//third-party:serde_derive",
    "fixups//third-party:serde-json",
    "fixups//third-party:md-5",
    "fixups//third-party:quote",
    f"fixups//{RIG}:quote-1",
    f"fixups//{RIG}:other-2.1",
    f"fixups//{RIG}/sub:deep",
]


def test_impacted_targets(table):
    targets = table("label STRING", *[(t,) for t in TARGETS])
    hits = I.impacted_targets(table("crate STRING", ("serde",)), targets)
    assert as_set(hits) == {("fixups//third-party:serde",), ("fixups//third-party:serde-1",)}
    changed = table("crate STRING", ("md-5",), ("serde-jso",), ("gone",))
    assert as_set(I.impacted_targets(changed, targets)) == {("fixups//third-party:md-5",)}
    assert as_set(I.unmatched_changes(changed, targets)) == {("serde-jso",), ("gone",)}


def test_change_impact(table):
    paths = table("path STRING", (f"{RIG}/fixups/quote/fixups.toml",), ("fixups/serde/x.patch",), ("README.md",))
    targets = table("label STRING", *[(t,) for t in TARGETS])
    known = table("label STRING", ("fixups//third-party:serde",), (f"fixups//{RIG}:quote",), ("fixups//elsewhere:other",))
    # A rig override hits the crate in every rig and every target of its own rig;
    # known-broken stems go only in the same package.
    assert as_set(I.change_impact(paths, targets, known)) == {
        ("fixups//third-party:quote",),
        (f"fixups//{RIG}:other-2.1",),
    }


def test_exact_names_are_not_broken_by_their_stem(table):
    candidates = table("label STRING", ("p:ark-bls12-377",), ("p:ark-bls12-381",))
    known = table("label STRING", ("p:ark-bls12-381",))
    assert as_set(I.drop_known_broken(candidates, known)) == set()
    names = ["ark-bls12-377", "ark-bls12-381"]
    assert as_set(I.drop_known_broken(candidates, known, names)) == {("p:ark-bls12-377",)}


def test_kinds(table):
    targets = table("label STRING, kind STRING", ("a", "alias"), ("b", "cargo.rust_library"), ("c", "http_archive"), ("d", "rust_library"))
    assert as_set(I.of_kind(targets).select("label")) == {("a",), ("b",), ("d",)}
    assert as_set(I.of_kind(targets, ["alias"]).select("label")) == {("a",)}


# Lines -----------------------------------------------------------------------------


def test_lines_of_logs(table):
    logs = table("slot STRING, content STRING", ("a", "x\n# c\n\nError 1\nerror 2\nlast\n"), ("b", "one"))
    assert as_set(LL.entries(logs)) == {("a", 1, "x"), ("a", 4, "Error 1"), ("a", 5, "error 2"), ("a", 6, "last"), ("b", 1, "one")}
    assert as_set(LL.head_of_text(logs, 2)) == {("a", 1, "x"), ("a", 2, "# c"), ("b", 1, "one")}
    assert as_set(LL.tail_of_text(logs, 2)) == {("a", 5, "error 2"), ("a", 6, "last"), ("b", 1, "one")}
    assert as_set(LL.errors_of_text(logs, 1)) == {("a", 4, "Error 1")}
    from sweepledger.sources.files import number_lines

    lines = number_lines(logs)
    assert as_set(LL.head_lines(lines, ["slot"], 2)) == as_set(LL.head_of_text(logs, 2))
    assert as_set(LL.tail_lines(lines, ["slot"], 2)) == as_set(LL.tail_of_text(logs, 2))
    assert as_set(LL.error_lines(lines, ["slot"], 1)) == as_set(LL.errors_of_text(logs, 1))


def test_bounded_lines_are_cut_before_the_shuffle(table):
    lines = table("slot STRING, line_no INT, line STRING", ("a", 1, "x"))
    plan = LL.tail_lines(lines, ["slot"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_first_blame(table):
    log = table(
        "slot STRING, round INT, line_no INT, line STRING",
        ("a", 1, 3, "no matching package named `late` found"),
        ("a", 1, 2, "error: failed to select a version for `first`."),
        ("a", 1, 1, "error: something else"),
        ("a", 2, 1, "error: something else"),
        ("b", 1, 1, "no matching package named `` found"),
        ("b", 1, 2, "no matching package named `second` found"),
    )
    assert as_set(LL.first_blame(log)) == {("a", 1, "first"), ("a", 2, None), ("b", 1, None)}
    texts = table("slot STRING, content STRING", ("a", "x\nno matching package named `p` found\nno matching package named `q` found"), ("b", "x"))
    assert as_set(LL.first_blame_of_text(texts)) == {("a", "p"), ("b", None)}


# Manifests -------------------------------------------------------------------------


def test_float_and_print(table):
    deps = table(
        "slot STRING, crate STRING, version_req STRING, features ARRAY<STRING>, default_features BOOLEAN, package STRING",
        ("s", "plain", "1.0", None, None, None),
        ("s", "empty", "1.0", [], True, None),
        ("s", "both", "1", ["a", "b"], False, None),
        ("s", "feat", "1", ["a"], True, None),
        ("s", "nodef", "1", [], False, None),
        ("s", "ring", "=1", None, None, None),
        ("s", "matchit_v8", "=1", None, None, "matchit"),
    )
    lines = M.manifest_lines(M.float_deps(deps))
    assert as_set(lines.select("line")) == {
        ('plain = "*"',),
        ('empty = "*"',),
        ('both = { version = "*", default-features = false, features = ["a", "b"] }',),
        ('feat = { version = "*", features = ["a"] }',),
        ('nodef = { version = "*", default-features = false }',),
    }


@pytest.mark.parametrize("limit", [0, 1 << 25])
def test_null_nodes_come_out_once(spark, table, monkeypatch, limit):
    """Whether the nodes seen are compared by a join or by a grouping."""
    monkeypatch.setattr(P, "BROADCAST_BYTES", limit)
    edges = table("src INT, dst INT", (None, 1), (None, 2), (None, 3), (2, 1), (3, 2), (4, None))
    got = G.dependents_closure(edges, table("node INT", (1,)))
    assert as_set(got) == {(1, 0), (2, 1), (None, 1), (3, 2)}
    scoped = G.dependents_closure(edges.withColumn("s", F.lit(None).cast("int")), table("s INT, node INT", (None, 1)), ["s"])
    assert as_set(scoped.select("node", "depth")) == {(1, 0)}  # a null scope is none either


def test_slot_and_platform_matrix(table):
    deps = table(
        "rig STRING, crate STRING",
        *[("main", "a"), ("2024-11", "a"), ("2025-05", "a"), ("2025-05", "b"), ("2025-05", "b"), ("other", "c"), ("main", "d")],
    )
    matrix = M.slot_matrix(deps, ["2025-05", "2024-11"]).select(
        "crate", "`in_2024-11`", "`in_2025-05`", "first_slot", "n_slots", "absent_vs_main"
    )
    assert as_set(matrix) == {
        ("a", True, True, "2024-11", 2, False),
        ("b", False, True, "2025-05", 1, True),
        ("d", False, False, None, 0, False),
        ("c", False, False, None, 0, True),  # of a rig that is not listed: marked, not dropped
    }
    more = deps.unionByName(table("rig STRING, crate STRING", (None, "e"), ("main", "e"), ("other", "a")))
    assert as_set(M.slot_matrix(more, ["2025-05", "2024-11"]).where("in_other").select("crate", "absent_vs_main")) == {
        ("a", False), ("c", True), ("e", False)
    }
    known = table("platform STRING, label STRING", ("L", "x"), ("W", "x"), ("L", "y"), ("L", "y"), ("M", "z"), ("M", "x"), (None, "w"))
    got = M.platform_matrix(known, ["L", "W"]).select("label", "on_L", "on_W", "on_other", "n_platforms", "everywhere")
    assert as_set(got) == {
        ("x", True, True, True, 2, True),
        ("y", True, False, False, 1, False),
        ("z", False, False, True, 0, False),
        ("w", False, False, True, 0, False),
    }


def test_era_latest(table):
    index = table(
        "crate STRING, version STRING, slot STRING, yanked BOOLEAN",
        ("a", "1.0.9", "1", False),
        ("a", "1.0.27", "3", False),
        ("a", "2.0.0", "2", True),
        ("a", "2.0.0-rc.1", "2", False),
        ("a", "1.0.10", "4", False),
        ("b", "0.1", "2", False),
    )
    assert as_set(M.era_latest(index, ["1", "2", "3", "4"]).select("crate", "slot", "version")) == {
        ("a", "1", "1.0.9"),
        ("a", "2", "1.0.9"),
        ("a", "3", "1.0.27"),
        ("a", "4", "1.0.27"),
        ("b", "2", "0.1"),
        ("b", "3", "0.1"),
        ("b", "4", "0.1"),
    }


def test_apply_blame(table):
    manifest = table("slot STRING, crate STRING", ("a", "foo"), ("a", "bar"), ("b", "foo"), ("c", "foo"))
    log = table(
        "slot STRING, round INT, line_no INT, line STRING",
        ("a", 1, 1, "error: no matching package named `foo` found"),
        ("b", 1, 1, "error: failed to select a version for `deep`."),
        ("c", 1, 1, "error: something else"),
    )
    kept, dropped, errors = M.apply_blame(manifest, log)
    assert as_set(kept) == {("a", "bar"), ("b", "foo"), ("c", "foo")}
    assert as_set(dropped) == {("a", 1, "foo")}
    assert as_set(errors) == {("b", 1, "deep", "transitive"), ("c", 1, None, "unhandled")}


def test_prune(table):
    members = table(
        "slot STRING, crate STRING, available BOOLEAN",
        *[("s", c, c != "gone") for c in ("gone", "one", "two", "three", "ok", "lib", "asks", "rival1", "rival2", "alone", "loop")],
        ("t", "one", True),
        ("t", "gone", True),
    )
    needs = table(
        "slot STRING, crate STRING, needs STRING, feature STRING",
        ("s", "one", "gone", None),
        ("s", "two", "one", None),
        ("s", "three", "two", None),
        ("s", "asks", "lib", "big"),
        ("s", "alone", "nowhere", None),
        ("s", "loop", "loop", None),
        ("t", "one", "gone", None),
    )
    conflicts = table("slot STRING, conflict_id INT, line_no INT, crate STRING", ("s", 1, 4, "rival1"), ("s", 1, 4, "rival2"))
    offered = table("slot STRING, crate STRING, feature STRING", ("s", "lib", "small"))
    dropped = M.prune_to_consistent(members, needs, conflicts, offered)
    want = {
        ("s", "gone", 1),
        ("s", "alone", 1),
        ("s", "lib", 1),
        ("s", "rival1", 5),  # conflicts are judged once nothing else drops
        ("s", "one", 2),
        ("s", "asks", 2),
        ("s", "two", 3),
        ("s", "three", 4),
    }
    assert as_set(dropped) == want
    with pytest.raises(P.RoundsExceeded):
        M.prune_to_consistent(members, needs, conflicts, offered, max_rounds=4)
    assert as_set(M.prune_to_consistent(members, needs, conflicts, offered, max_rounds=5)) == want
    assert as_set(M.pruned_list(dropped.union(dropped)).select("round", "crate")) == {(n, crate) for _, crate, n in want}


# Gates -----------------------------------------------------------------------------


def gates_of(table, *rows):
    return V.with_bounds(table("crate STRING, gate STRING", *rows))


def resolved_of(table, *rows):
    return V.with_version_key(table("rig STRING, crate STRING, version STRING", *rows))


def test_gates(table):
    gates = gates_of(
        table,
        ("semver", 'cfg(version = ">=1.0.0, <1.0.27")'),
        ("serde", 'cfg(version = ">=1.0.228")'),
        ("ring", 'cfg(version = "=0.17.14")'),
        ("ring", 'cfg(version = "=0.17.5")'),
    )
    resolved = resolved_of(
        table,
        ("main", "semver", "1.0.27"),
        ("old", "semver", "1.0.26"),
        ("main", "serde", "1.0.228"),
        ("main", "ring", "0.17.14"),
        ("old", "ring", "0.17.8"),
        ("main", "libc", "0.2.1"),
    )
    assert as_set(V.gate_matches(resolved, gates).select("rig", "crate", "gate")) == {
        ("old", "semver", 'cfg(version = ">=1.0.0, <1.0.27")'),
        ("main", "serde", 'cfg(version = ">=1.0.228")'),
        ("main", "ring", 'cfg(version = "=0.17.14")'),
    }
    assert as_set(V.dead_gates(gates, resolved).select("gate")) == {('cfg(version = "=0.17.5")',)}
    uncovered = V.uncovered_versions(resolved, gates.where("exact"))
    assert [(r["crate"], r["v"]) for r in uncovered.collect()] == [("ring", [0, 17, 8])]
    assert as_set(V.unused_fixups(gates, resolved.where("crate != 'ring'"))) == {("ring",)}


def test_effective_directives(table):
    directives = table(
        "rig_scope STRING, crate STRING, section_no INT, gate STRING, key STRING, value_kind STRING, value_json STRING",
        ("", "serde", 0, None, "buildscript.run", "bool", "false"),
        ("", "serde", 1, 'cfg(version = ">=1.0.228")', "buildscript.run", "bool", "true"),
        ("", "serde", 1, 'cfg(version = ">=1.0.228")', "cargo_env", "bool", "true"),
        ("", "winapi", 0, None, "buildscript.run", "bool", "false"),
        ("", "winapi", 1, 'cfg(target_os = "windows")', "buildscript.run", "bool", "true"),
        ("", "quote", 0, None, "buildscript.run", "bool", "false"),
        ("", "quote", 0, None, "features", "array", "[]"),
        ("sqlx", "quote", 0, None, "buildscript.run", "bool", "true"),
        ("", "empty", 0, None, "buildscript.run", "bool", "true"),
        ("sqlx", "empty", 0, None, None, None, None),
        ("sqlx", "absent", 0, None, "buildscript.run", "bool", "true"),
    )
    resolved = table(
        "rig STRING, crate STRING, version STRING",
        ("main", "serde", "1.0.228"),
        ("old", "serde", "1.0.9"),
        ("main", "winapi", "0.3.9"),
        ("main", "quote", "1.0.0"),
        ("sqlx", "quote", "1.0.0"),
        ("sqlx", "empty", "1.0.0"),
        ("main", "empty", "1.0.0"),
    )
    platforms = [("W", "windows", "x86_64", "msvc"), ("L", "linux", "x86_64", "gnu")]
    got = as_set(V.effective_directives(directives, resolved, platforms))
    linux = {(r[0], r[1], r[4], r[5]) for r in got if r[3] == "L"}
    assert linux == {
        ("main", "serde", "buildscript.run", "true"),
        ("main", "serde", "cargo_env", "true"),
        ("old", "serde", "buildscript.run", "false"),
        ("main", "winapi", "buildscript.run", "false"),
        ("main", "quote", "buildscript.run", "false"),
        ("main", "quote", "features", "[]"),
        ("sqlx", "quote", "buildscript.run", "true"),
        ("main", "empty", "buildscript.run", "true"),
    }
    windows = {(r[0], r[1], r[4], r[5]) for r in got if r[3] == "W"}
    assert windows - linux == {("main", "winapi", "buildscript.run", "true")}


def test_gate_straddle(table):
    hits = table(
        "crate STRING, gate STRING, slot STRING, hit BOOLEAN",
        ("a", "g", "1", True),
        ("a", "g", "1", False),
        ("a", "g", "2", False),
        ("a", "g", "3", False),
        ("b", "g", "1", True),
        ("b", "g", "2", True),
    )
    assert as_set(V.gate_straddle(hits)) == {("a", "g", "2", True, False)}


# Graphs ----------------------------------------------------------------------------


def closure(edges, seeds):
    depth, frontier, n = dict.fromkeys(seeds, 0), set(seeds), 0
    while frontier:
        n += 1
        frontier = {s for s, d in edges if d in frontier and s not in depth}
        depth.update(dict.fromkeys(frontier, n))
    return set(depth.items())


@pytest.mark.parametrize("broadcast_bytes", [P.BROADCAST_BYTES, 0])
def test_closure_equals_brute_force(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(P, "BROADCAST_BYTES", broadcast_bytes)
    monkeypatch.setattr(P, "COMPACT_EVERY", 3)
    rng = random.Random(3)
    # Random edges with cycles, a chain, and one node that many depend on.
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(50)]
    edges += [(f"n{i + 1}", f"n{i}") for i in range(100, 112)] + [(f"m{i}", "n100") for i in range(50)]
    seeds = ["n1", "n2", "n100", "unknown"]
    got = G.dependents_closure(
        spark.createDataFrame(edges, "src STRING, dst STRING"), spark.createDataFrame([(s,) for s in seeds], "node STRING")
    )
    assert as_set(got) == closure(edges, seeds)


def test_closure_stays_in_its_scope(table):
    edges = table("rig STRING, src STRING, dst STRING", ("r", "b", "a"), ("q", "c", "a"), ("q", "a", "c"))
    seeds = table("rig STRING, node STRING", ("r", "a"), ("q", "c"))
    assert as_set(G.dependents_closure(edges, seeds, ["rig"])) == {("r", "a", 0), ("r", "b", 1), ("q", "c", 0), ("q", "a", 1)}


def test_dangling_and_links(table):
    refs = table("label STRING", ("a",), ("a",), ("b",))
    targets = table("label STRING", ("b",), ("c",))
    assert as_set(G.dangling_labels(refs, targets)) == {("a", "dangling"), ("c", "unreferenced")}
    packages = table(
        "rig STRING, links STRING, package STRING, version STRING",
        ("r", "sqlite3", "libsqlite3-sys", "0.30.1"),
        ("r", "sqlite3", "libsqlite3-sys", "0.33.0"),
        ("r", "sqlite3", "libsqlite3-sys", "0.33.0"),
        ("q", "sqlite3", "libsqlite3-sys", "0.30.1"),
        ("r", None, "serde", "1"),
        ("r", None, "syn", "1"),
    )
    conflicts = G.links_conflicts(packages).select("rig", "links", "version", "n_claimants")
    assert as_set(conflicts) == {("r", "sqlite3", "0.30.1", 2), ("r", "sqlite3", "0.33.0", 2)}


# Collections and drift -------------------------------------------------------------


def test_sync(table):
    schema = "crate STRING, path STRING, content_hash STRING"
    source = table(schema, ("new", "f", "1"), ("new", "g", "1"), ("both", "f", "2"), ("both", "added", "2"))
    target = table(schema, ("both", "f", "old"), ("both", "own", "old"), ("mine", "f", "old"))
    assert as_set(S.insert_if_absent(source, target)) == {
        ("new", "f", "1"),
        ("new", "g", "1"),
        ("both", "f", "old"),
        ("both", "own", "old"),
        ("mine", "f", "old"),
    }
    assert as_set(S.insert_status(source, target)) == {("new", "Copied"), ("both", "Skipped")}
    assert as_set(S.refresh_matched(source, target)) == {
        ("both", "f", "2"),
        ("both", "added", "2"),
        ("both", "own", "old"),
        ("mine", "f", "old"),
    }
    assert as_set(S.refresh_status(source, target)) == {("both", "Copied"), ("mine", "NoSource")}


def test_drift(table):
    schema = "rig STRING, name STRING, v STRING"
    committed = table(schema, ("r", "same", "1"), ("r", "changed", "1"), ("r", "gone", None), ("r", "null", None))
    regenerated = table(schema, ("r", "same", "1"), ("r", "changed", "2"), ("r", "made", "1"), ("r", "null", None))
    records = D.drift_records(committed, regenerated, ["rig", "name"], ["v"])
    assert as_set(records.select("name", "change")) == {("changed", "changed"), ("gone", "removed"), ("made", "added")}
    assert as_set(D.drift_counts(records)) == {("r", 1, 1, 1)}
    files = "rig STRING, content_hash STRING"
    status = D.drift_of_files(table(files, ("a", "1"), ("b", "1")), table(files, ("a", "1"), ("b", "2"), ("c", "3")))
    assert as_set(status) == {("a", "same"), ("b", "stale"), ("c", "new")}


def test_rig_status(table):
    runs = table("rig STRING, tool_failed BOOLEAN", ("a", False), ("b", True), ("c", False), ("d", False), ("e", False))
    output = table("rig STRING, line STRING", ("c", "warning"), ("a", ""), ("b", "boom"))
    drifted = table("rig STRING, status STRING", ("d", "stale"), ("e", "new"), ("a", "same"))
    statuses = D.rig_status(runs, output, drifted)
    assert as_set(statuses) == {
        ("a", False, None),
        ("b", True, "tool failed"),
        ("c", True, "not clean"),
        ("d", True, "stale"),
        ("e", False, None),
    }
    assert as_set(D.overall_status(statuses)) == {(5, 3, True)}
    assert as_set(D.rig_status(runs, output, drifted, check=False).where("failed").select("rig")) == {("b",)}


# Sinks -----------------------------------------------------------------------------


def test_argument_strings_are_whole(spark, tmp_path):
    labels = [(g, f"//{g}:{i:03d}") for g, n in (("hot", 300), ("cold", 3)) for i in range(n)]
    df = spark.createDataFrame(labels + labels, "package STRING, label STRING").repartition(5)
    K.write_arg_strings(df, str(tmp_path / "args"), ["package"])
    for group in ("hot", "cold"):
        files = sorted((tmp_path / f"args/package={group}").glob("part-*"))
        assert "".join(f.read_text() for f in files) == "".join(label + " " for p, label in labels if p == group)


def test_written_labels_and_manifests(table, spark, tmp_path):
    labels = table("label STRING", ("b",), ("a",), ("c",), ("b",))
    K.write_label_lines(labels, str(tmp_path / "labels"))
    files = sorted((tmp_path / "labels").glob("part-*"))
    assert "".join(f.read_text() for f in files).split() == ["a", "b", "c"]
    deps = table(
        "slot STRING, crate STRING, version_req STRING, features ARRAY<STRING>, default_features BOOLEAN",
        ("2025-11", "b", "*", None, None),
        ("2025-11", "a", "*", ["x"], None),
        ("2024-11", "a", "*", None, False),
    )
    K.write_manifests(deps, str(tmp_path / "manifests"))
    files = sorted((tmp_path / "manifests/slot=2025-11").glob("part-*"))
    text = "".join(f.read_text() for f in files)
    assert text == 'a = { version = "*", features = ["x"] }\nb = "*"\n'


def test_manifest_round_trip(table, spark, tmp_path):
    """What is written is read back as the same requirements."""
    from sweepledger.sources.manifests import parse_manifest_deps

    deps = table(
        "slot STRING, crate STRING, version_req STRING, features ARRAY<STRING>, default_features BOOLEAN",
        ("s", "b", "*", None, None),
        ("s", "a", "*", ["x", "y"], False),
    )
    lines = M.manifest_lines(deps)
    content = F.concat(F.lit("[dependencies]\n"), "line")
    parsed = parse_manifest_deps(lines.select(F.col("slot").alias("source"), content.alias("content")))
    assert {json.dumps(r.asDict()) for r in parsed.drop("source", "package").collect()} == {
        json.dumps(r.asDict()) for r in deps.select("crate", "version_req", "features", "default_features").collect()
    }
