"""The jobs over files, end to end on small trees."""

import json

import pytest
from frames import as_set
from test_sources import TARGETS, write

from sweepledger.operators import loglines as LL
from sweepledger.plans import jobs
from sweepledger.session import drop_scratch, scratch_mark, scratch_path, stage
from sweepledger.sinks.files import copy_members
from sweepledger.sources.files import read_lines_in_order


def lines(path):
    return [line for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]


def test_sweep(spark, tmp_path):
    def report(**outcomes):
        return json.dumps({"results": {f"fixups//third-party:{k}#lib": {"success": v} for k, v in outcomes.items()}})

    reports = write(
        tmp_path / "reports",
        {"L/1/report.json": report(a="FAIL", b="SUCCESS"), "L/2/report.json": report(c="FAIL"), "W/1/report.json": report(a="FAIL", d="FAIL")},
    )
    logs = write(
        tmp_path / "logs",
        {"L/1/build.log": "fine\n", "L/2/build.log": "x evaluation of this key was cancelled\n", "W/1/build.log": "fine\n"},
    )
    known = write(
        tmp_path / "ci",
        {
            "expected-failures-L.txt": "# c\nfixups//third-party:a\nfixups//third-party/snapshots/2025-11:z\n",
            "expected-failures-W.txt": "fixups//third-party:a\nfixups//third-party:b\n",
        },
    )
    out = tmp_path / "out"
    row = jobs.sweep(spark, reports, known, str(out), ["//third-party:"], f"{logs}/*/*/*.log", is_ci=False, named=["1"])
    assert (row["n_runs"], row["n_failed"]) == (3, 2)
    got = spark.read.parquet(f"{out}/lines").select("platform", "run_id", "kind", "label")
    p = "fixups//third-party:"
    assert as_set(got) == {
        ("L", "1", "ok", None),
        ("L", "2", "cancelled", None),
        ("W", "1", "fail", None),
        ("W", "1", "new", p + "d"),
        ("W", "1", "stale", p + "b"),
        ("W", None, "stale", p + "b"),
    }


def test_sweep_without_a_readable_report(spark, tmp_path):
    """Every run has a verdict: no results, a report cut off, an empty file, and all of them cancelled."""
    reports = write(tmp_path / "reports", {"L/1/r.json": "{}", "L/2/r.json": '{"results": {"a', "L/3/r.json": ""})
    known = write(tmp_path / "ci", {"expected-failures-L.txt": "fixups//third-party:a\n", "NOTES.md": "fixups//third-party:x\n"})
    row = jobs.sweep(spark, reports, known, str(tmp_path / "out"), ["//third-party:"], is_ci=True)
    assert (row["n_runs"], row["n_failed"]) == (3, 3)
    verdicts = spark.read.parquet(str(tmp_path / "out/verdicts")).select("run_id", "verdict", "stale_count")
    assert as_set(verdicts) == {("1", "fail", 1), ("2", "unreadable", None), ("3", "unreadable", None)}
    stopped = {f"L/{i}/build.log": "x evaluation of this key was cancelled\n" for i in (1, 2, 3)}
    logs = write(tmp_path / "logs", stopped)
    row = jobs.sweep(spark, reports, known, str(tmp_path / "again"), ["//third-party:"], f"{logs}/*/*/*.log")
    assert (row["n_runs"], row["n_failed"]) == (3, 3)
    assert as_set(spark.read.parquet(str(tmp_path / "again/lines")).select("run_id", "kind")) == {(i, "cancelled") for i in "123"}


def test_impact(spark, tmp_path):
    paths = write(tmp_path / "c", {"paths.txt": "fixups/serde/x.toml\nfixups/gone/x.toml\n"})
    known = write(tmp_path / "ci", {"expected-failures-L.txt": "fixups//rig:serde\n"})
    stored = str(tmp_path / "targets")
    rows = [("fixups//third-party:serde", "alias"), ("fixups//rig:serde-1", "cargo.rust_library"), ("fixups//x:serde", "genrule")]
    spark.createDataFrame(rows, "label STRING, kind STRING").write.parquet(stored)
    assert jobs.impact(spark, paths, stored, known, str(tmp_path / "out"))["n_labels"] == 1
    assert lines(tmp_path / "out/labels") == ["fixups//third-party:serde"]
    assert lines(tmp_path / "out/skipped") == ["gone"]


def test_impact_by_name(spark, tmp_path):
    """Names instead of paths; snapshots are out of reach; a list that is not there is an empty one."""
    stored = str(tmp_path / "targets")
    labels = ["third-party:serde", "third-party/conflict-rigs/a:serde-1", "third-party/conflict-rigs/a:x", "third-party/snapshots/2025-11:serde"]
    rows = [(f"fixups//{label}", "alias") for label in labels]
    spark.createDataFrame(rows, "label STRING, kind STRING").write.parquet(stored)
    missing = str(tmp_path / "none/expected-failures-L.txt")
    row = jobs.impact(spark, None, stored, missing, str(tmp_path / "o"), crates=["serde", "gone"], rigs=["third-party/conflict-rigs/a"])
    assert row["n_labels"] == 3 and lines(tmp_path / "o/skipped") == ["gone"]
    assert lines(tmp_path / "o/labels") == sorted(f"fixups//{label}" for label in labels[:3])
    assert jobs.impact(spark, None, stored, None, str(tmp_path / "n"))["n_labels"] == 0
    wide = jobs.impact(spark, None, stored, None, str(tmp_path / "w"), crates=["serde"], patterns=["//third-party/..."])
    assert wide["n_labels"] == 3


def test_matrix(spark, tmp_path):
    known = write(tmp_path / "ci", {"expected-failures-L.txt": "fixups//a:x\nfixups//a:y\n", "expected-failures-W.txt": "fixups//a:x\n"})
    manifest = lambda *crates: "[dependencies]\n" + "".join(f'{c} = "1"\n' for c in crates)
    root = write(
        tmp_path / "tree",
        {
            "third-party/Cargo.toml": manifest("a", "new"),
            "third-party/snapshots/2024-11/Cargo.toml": manifest("a", "old"),
            "third-party/snapshots/2025-05/Cargo.toml": manifest("a"),
            "third-party/conflict-rigs/q/Cargo.toml": manifest("only"),
            "third-party/snapshots/broken/Cargo.toml": "[dep",
        },
    )
    row = jobs.matrix(spark, known, root, str(tmp_path / "m"))
    assert row.asDict() == {"n_labels": 2, "n_crates": 4, "n_errors": 1}
    failing = spark.read.parquet(str(tmp_path / "m/platforms")).select("label", "on_L", "on_W", "everywhere")
    assert as_set(failing) == {("fixups//a:x", True, True, True), ("fixups//a:y", True, False, False)}
    slots = spark.read.parquet(str(tmp_path / "m/slots")).select("crate", "`in_2024-11`", "`in_2025-05`", "in_other", "first_slot", "absent_vs_main")
    assert as_set(slots) == {
        ("a", True, True, False, "2024-11", False),
        ("new", False, False, False, None, False),
        ("old", True, False, False, "2024-11", True),
        ("only", False, False, True, None, True),
    }


def test_mint(spark, tmp_path):
    root = write(tmp_path / "repo", {"third-party/Cargo.toml": '[dependencies]\na = "1"\nb = { version = "1", features = ["x"] }\nring = "=1"\nlate = "1"\n'})
    index, needs = str(tmp_path / "index"), str(tmp_path / "needs")
    spark.createDataFrame(
        [("a", "1.0.9", "2024-11", False), ("a", "1.0.10", "2025-05", False), ("b", "1.0.0", "2024-11", False), ("late", "1.0.0", "2025-05", False), ("deep", "0.1.0", "2024-11", False), ("rotten", "0.1.0", "2025-05", False)],
        "crate STRING, version STRING, slot STRING, yanked BOOLEAN",
    ).write.parquet(index)
    spark.createDataFrame([("2024-11", "b", "late"), ("2025-05", "b", "late"), ("2024-11", "a", "deep"), ("2025-05", "rotten", "nowhere")], "slot STRING, crate STRING, needs STRING").write.parquet(needs)
    out = tmp_path / "out"
    row = jobs.mint(spark, root, ["2024-11", "2025-05"], index, needs, str(out))
    assert row["n_packages"] == 4
    assert lines(out / "manifests/slot=2024-11") == ['a = "*"']
    assert lines(out / "manifests/slot=2025-05") == ['a = "*"', 'b = { version = "*", features = ["x"] }', 'late = "*"']
    assert as_set(spark.read.parquet(f"{out}/pruned").select("slot", "round", "crate")) == {("2024-11", 1, "late"), ("2024-11", 2, "b")}
    assert as_set(spark.read.parquet(f"{out}/transitive").select("slot", "crate")) == {("2025-05", "rotten")}
    assert ("2025-05", "a", "1.0.10") in as_set(spark.read.parquet(f"{out}/locks"))


def test_mint_with_ranges_features_and_conflicts(spark, tmp_path):
    manifest = '[dependencies]\n' + "".join(f'{c} = "1"\n' for c in ("app", "lib", "rival1", "rival2")) + 'plain = { version = "1", features = ["big"] }\n'
    root = write(tmp_path / "repo", {"third-party/Cargo.toml": manifest})
    stored = {name: str(tmp_path / name) for name in ("index", "needs", "features", "conflicts")}
    versions = [("app", "1.0.0"), ("lib", "1.0.0"), ("lib", "2.0.0"), ("rival1", "1.0.0"), ("rival2", "1.0.0"), ("plain", "1.0.0")]
    spark.createDataFrame([(c, v, "2024-11", False) for c, v in versions], "crate STRING, version STRING, slot STRING, yanked BOOLEAN").write.parquet(stored["index"])
    asked = [("2024-11", "lib", "2.0.0", "app", ">=2"), ("2024-11", "app", None, "lib", "<2"), ("2024-11", "app", None, "lib", "odd")][:2]
    spark.createDataFrame(asked, "slot STRING, crate STRING, version STRING, needs STRING, version_req STRING").write.parquet(stored["needs"])
    spark.createDataFrame([("2024-11", "plain", "small")], "slot STRING, crate STRING, feature STRING").write.parquet(stored["features"])
    rivals = [("2024-11", 1, 1, "rival1"), ("2024-11", 1, 2, "rival2")]
    spark.createDataFrame(rivals, "slot STRING, conflict_id INT, line_no INT, crate STRING").write.parquet(stored["conflicts"])
    config = write(tmp_path / "c", {"good.json": '{"dl": "https://static.crates.io/x"}', "bad.json": '{"dl": "https://elsewhere"}'})
    logs = write(tmp_path / "logs", {"one.log": "12:00 fixups] lib: no section\n"})
    rest = (stored["features"], stored["conflicts"], logs)
    with pytest.raises(ValueError, match="faithful"):
        jobs.mint(spark, root, ["2024-11"], stored["index"], stored["needs"], str(tmp_path / "no"), f"{config}/bad.json", *rest)
    assert not (tmp_path / "no").exists()
    out = tmp_path / "out"
    jobs.mint(spark, root, ["2024-11"], stored["index"], stored["needs"], str(out), f"{config}/good.json", *rest)
    assert as_set(spark.read.parquet(f"{out}/locks")) == {("2024-11", "app", "1.0.0"), ("2024-11", "lib", "1.0.0"), ("2024-11", "rival2", "1.0.0")}
    assert {r["crate"] for r in spark.read.parquet(f"{out}/pruned").collect()} == {"plain", "rival1"}
    assert [r["line"] for r in spark.read.parquet(f"{out}/gaps").collect()] == ["  lib: no section"]
    assert spark.read.parquet(f"{out}/unread").count() == 0


def test_drift(spark, tmp_path):
    changed = TARGETS.replace('edition = "2021"', 'edition = "2024"')
    kept = write(tmp_path / "kept", {"main/BUCK": TARGETS, "rig/BUCK": TARGETS})
    made = write(tmp_path / "made", {"main/BUCK": TARGETS, "rig/BUCK": changed, "fresh/BUCK": TARGETS})
    runs = spark.createDataFrame([("main", False), ("rig", False), ("fresh", False)], "rig STRING, tool_failed BOOLEAN")
    output = spark.createDataFrame([], "rig STRING, line STRING")
    row = jobs.drift(spark, kept, made, output, runs, str(tmp_path / "out"))
    assert (row["n_rigs"], row["n_failed"], row["failed"]) == (3, 1, True)
    shown = spark.read.parquet(str(tmp_path / "out/shown")).where("rig = 'rig'")
    assert as_set(shown.select("name", "change")) == {("pebble-2", "changed")}


def test_files_are_copied_once(spark, tmp_path):
    source = write(tmp_path / "s", {"new/f": "1", "new/deep/g": "1", "both/f": "2", "both/g": "2"})
    target = write(tmp_path / "t", {"both/f": "1", "own/f": "1"})

    def state():
        return {str(p.relative_to(target)): p.read_text() for p in (tmp_path / "t").rglob("*") if p.is_file() and not p.name.endswith(".crc")}

    def copied(name):
        return as_set(spark.read.parquet(str(tmp_path / name / "copied")))

    jobs.refresh(spark, source, target, str(tmp_path / "r"), copy=True)
    assert copied("r") == {("both", "f", "copied"), ("both", "g", "copied")}
    assert state() == {"both/f": "2", "both/g": "2", "own/f": "1"}
    jobs.extend(spark, source, target, str(tmp_path / "e"), copy=True)
    assert copied("e") == {("new", "f", "copied"), ("new", "deep/g", "copied")}
    want = {"both/f": "2", "both/g": "2", "own/f": "1", "new/f": "1", "new/deep/g": "1"}
    assert state() == want
    for name, job in (("r2", jobs.refresh), ("e2", jobs.extend)):
        job(spark, source, target, str(tmp_path / name), copy=True)
        assert copied(name) == set() and state() == want  # no file left under an attempt's name either
    listed = spark.createDataFrame([("new", "f", "0" * 64)], "crate STRING, path STRING, content_hash STRING")
    assert as_set(copy_members(listed, source, target)) == {("new", "f", "changed")} and state() == want


def test_extend_and_refresh(spark, tmp_path):
    source = write(tmp_path / "s", {"new/f": "1", "both/f": "2", "both/g": "2"})
    target = write(tmp_path / "t", {"both/f": "1", "own/f": "1"})
    assert jobs.extend(spark, source, target, str(tmp_path / "e"))["n_copied"] == 1
    members = spark.read.parquet(str(tmp_path / "e/members")).select("crate", "path")
    assert as_set(members) == {("new", "f"), ("both", "f"), ("own", "f")}
    assert jobs.refresh(spark, source, target, str(tmp_path / "r"))["n_copied"] == 1
    members = spark.read.parquet(str(tmp_path / "r/members")).select("crate", "path")
    assert as_set(members) == {("both", "f"), ("both", "g"), ("own", "f")}


def test_lines_of_large_files_keep_their_order(spark, tmp_path):
    path = write(tmp_path, {"a.log": "".join(f"line {i:04d} error\n" for i in range(2000)), "b.log": "x\nerror y\n"})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = read_lines_in_order(spark, path)
        assert rows.rdd.getNumPartitions() > 5
        first = LL.head_lines(rows, ["path"], 3).select("line")
        last = LL.tail_lines(rows, ["path"], 2).select("line")
        assert as_set(first) == {("line 0000 error",), ("line 0001 error",), ("line 0002 error",), ("x",), ("error y",)}
        assert as_set(last) == {("line 1998 error",), ("line 1999 error",), ("x",), ("error y",)}
        blamed = LL.first_blame(rows, ["path"], [r"^line (\d+) error"]).select("crate")
        assert as_set(blamed) == {("0000",), (None,)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_command_line(spark, tmp_path):
    from sweepledger.__main__ import main

    results = {"results": {"fixups//third-party:a": {"success": "FAIL"}}}
    reports = write(tmp_path / "reports", {"L/1/report.json": json.dumps(results)})
    known = write(tmp_path / "ci", {"expected-failures-L.txt": "fixups//third-party:b\n"})
    common = ["sweep", "--reports", reports, "--known", known]
    assert main([*common, "--out", str(tmp_path / "o1")]) == 1
    write(tmp_path / "ci", {"expected-failures-L.txt": "fixups//third-party:a\nfixups//third-party:b\n"})
    assert main([*common, "--out", str(tmp_path / "o2")]) == 0
    assert main([*common, "--out", str(tmp_path / "o3"), "--ci"]) == 1
    assert main([*common, "--out", str(tmp_path / "o4"), "--ci", "//third-party:a"]) == 0
    source, target = (write(tmp_path / n, {f"{n}/f": "1"}) for n in ("s", "t"))
    assert main(["extend", source, target, "--out", str(tmp_path / "o5")]) == 0


def test_directives(spark, tmp_path):
    shared = "run = false\n['cfg(version = \"=1\")']\nrun = true\n['cfg(version = \"=9\")']\nrun = 1\n"
    root = write(
        tmp_path / "tree",
        {
            "fixups/a/fixups.toml": shared,
            "fixups/idle/fixups.toml": "run = true\n",
            "fixups/odd/fixups.toml": "['cfg(version = \"soon\")']\nrun = true\n",
            "main/fixups/a/fixups.toml": "run = 7\n",
            "main/Cargo.lock": '[[package]]\nname = "a"\nversion = "1.0.0"\n[[package]]\nname = "odd"\nversion = "2.0.0"\n',
            "side/Cargo.lock": '[[package]]\nname = "a"\nversion = "1.0.0"\n[[package]]\nname = "a"\nversion = "2.0.0"\n',
        },
    )
    out = str(tmp_path / "out")
    row = jobs.directives(spark, root, root, out, [("l", "linux", "x", "")])
    counts = {"n_effective": 3, "n_dead": 1, "n_uncovered": 1, "n_gaps": 1, "n_overlaps": 0, "n_shadowed": 0, "n_unused": 1, "n_unread": 1, "n_errors": 0}
    assert row.asDict() == counts
    in_force = spark.read.parquet(f"{out}/effective").select("rig", "crate", "version", "value_json")
    assert as_set(in_force) == {("main", "a", "1.0.0", "7"), ("side", "a", "1.0.0", "true"), ("side", "a", "2.0.0", "false")}
    assert as_set(spark.read.parquet(f"{out}/unused")) == {("idle",)}


def test_graph(spark, tmp_path):
    system = 'LIBS = ["one.lib", "two.lib"]\n[\n    prebuilt(name = lib, flags = [lib])\n    for lib in LIBS\n]\n'
    rig = (
        'lib(name = "a", crate = "a", deps = [":b", "fixups//sys:one.lib"])\nlib(name = "b", crate = "b", deps = [":gone"])\n'
        'run(name = "x-1", crate = "x", version = "1", env = {"CARGO_MANIFEST_LINKS": "z"})\n'
        'run(name = "x-2", crate = "x", version = "2", env = {"CARGO_MANIFEST_LINKS": "z"})\n'
    )
    root = write(tmp_path / "tree", {"sys/BUCK": system, "rig/BUCK": rig})
    known = write(tmp_path / "ci", {"expected-failures-L.txt": "fixups//sys:one.lib\n"})
    out = str(tmp_path / "out")
    row = jobs.graph(spark, root, known, out)
    assert row.asDict() == {"n_broken": 2, "n_causes": 2, "n_roots": 1, "n_unlisted": 0, "n_dangling": 1, "n_conflicts": 2, "n_errors": 0}
    assert as_set(spark.read.parquet(f"{out}/broken")) == {("L", "fixups//sys:one.lib", 0), ("L", "fixups//rig:a", 1)}
    assert as_set(spark.read.parquet(f"{out}/dangling")) == {("fixups//rig:gone",)}
    assert "fixups//sys:two.lib" in {r["label"] for r in spark.read.parquet(f"{out}/unreferenced").collect()}


def test_jobs_leave_no_scratch_folder(spark, tmp_path):
    """Nor does a job that fails; folders made before it stay."""
    path = stage(spark.range(3), "before").inputFiles()[0].split(":", 1)[-1].rsplit("/", 1)[0]
    mark = scratch_mark(spark)
    source, target = (write(tmp_path / n, {f"{n}/f": "1"}) for n in ("s", "t"))
    jobs.extend(spark, source, target, str(tmp_path / "e"))
    with pytest.raises(Exception, match="nowhere"):
        jobs.graph(spark, str(tmp_path / "nowhere"), str(tmp_path / "none"), str(tmp_path / "g"))
    assert scratch_mark(spark) == mark and spark.read.parquet(path).count() == 3
    made = [scratch_path(spark, "x") for _ in range(2)]
    for folder in made:
        spark.range(1).write.parquet(folder)
    assert drop_scratch(spark, mark, keep=made[:1]) == 1 and scratch_mark(spark) == mark + 1
    assert spark.read.parquet(made[0]).count() == 1 and drop_scratch(spark, mark) == 1
