"""Readers over small files written by the test."""

import hashlib
import json

from frames import as_set
from pyspark.sql import functions as F

from sweepledger.sources import manifests as SM
from sweepledger.sources import sweeps as SS
from sweepledger.sources import targets as ST
from sweepledger.sources.run_folders import EqualTo, In, RunFolderReader, read_run_folders


def write(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    return str(root)


def test_build_reports(spark, tmp_path):
    results = {"//a:x#lib": {"success": "SUCCESS"}, "//a:y#bin": {"success": "FAIL"}, "//a:z": {}}
    root = write(
        tmp_path / "reports",
        {
            "Linux-x86_64/r1/report.json": json.dumps({"results": results, "other": 1}, indent=1),
            "Linux-x86_64/r2/report.json": "{}",
        },
    )
    reports = SS.read_build_reports(spark, root)
    assert as_set(reports) == {
        ("r1", "Linux-x86_64", "//a:x#lib", "SUCCESS"),
        ("r1", "Linux-x86_64", "//a:y#bin", "FAIL"),
        ("r1", "Linux-x86_64", "//a:z", None),
    }
    staged = str(tmp_path / "staged")
    SS.stage_reports(reports, staged)
    again = spark.read.parquet(staged).select(*reports.columns)
    assert as_set(again) == as_set(reports)


def test_known_failures(spark, tmp_path):
    root = write(
        tmp_path,
        {
            "expected-failures-Linux-x86_64.txt": "# why\n\nfixups//a:x\nfixups//a:x\nfixups//a:y\n",
            "expected-failures-Darwin-arm64.txt": "fixups//a:x\n",
        },
    )
    rows = [tuple(r) for r in SS.read_known_failures(spark, root).collect()]
    assert sorted(rows) == [
        ("Darwin-arm64", "fixups//a:x"),
        ("Linux-x86_64", "fixups//a:x"),
        ("Linux-x86_64", "fixups//a:x"),
        ("Linux-x86_64", "fixups//a:y"),
    ]
    numbered = SS.read_numbered_known_failures(spark, root).where("platform = 'Linux-x86_64'")
    assert sorted(r["line_no"] for r in numbered.collect()) == [3, 4, 5]


def test_changed_paths_and_logs(spark, tmp_path):
    paths = write(tmp_path / "c", {"paths.txt": "fixups/serde/fixups.toml\n\nREADME.md\n"})
    assert as_set(SS.read_changed_paths(spark, paths)) == {("fixups/serde/fixups.toml",), ("README.md",)}
    logs = write(tmp_path / "l", {"2025-11/1.log": "a\nb\n", "2025-11/2.log": "c"})
    assert as_set(SS.read_resolver_logs(spark, logs)) == {
        ("2025-11", 1, 1, "a"),
        ("2025-11", 1, 2, "b"),
        ("2025-11", 2, 1, "c"),
    }


MANIFEST = """
[package]
name = "top"
[dependencies]
alpha = "3.1.4"  # why
beta_v2 = { version = "=2.7.1", package = "beta" }
gamma = { version = "0.9", default-features = false }
delta = { version = "1.4.0", default-features = false, features = ["red", "blue"] }
[target.'cfg(unix)'.dependencies]
unread = "1"
"""


def test_manifests_and_locks(spark, tmp_path):
    lock = 'version = 4\n[[package]]\nname = "a"\nversion = "1.0.0"\n[[package]]\nname = "a"\nversion = "2.0.0"\n'
    root = write(
        tmp_path,
        {
            "third-party/Cargo.toml": MANIFEST,
            "third-party/snapshots/2025-11/Cargo.toml": "[dependencies]\nalpha = '*'\n",
            "third-party/snapshots/2025-11/Cargo.lock": lock,
        },
    )
    deps = SM.read_manifest_deps(spark, root).withColumn("features", F.array_join("features", " "))
    assert as_set(deps) == {
        ("third-party", "alpha", "3.1.4", None, None, None),
        ("third-party", "beta_v2", "=2.7.1", None, None, "beta"),
        ("third-party", "gamma", "0.9", None, False, None),
        ("third-party", "delta", "1.4.0", "red blue", False, None),
        ("third-party/snapshots/2025-11", "alpha", "*", None, None, None),
    }
    assert as_set(SM.read_lock_packages(spark, root)) == {
        ("third-party/snapshots/2025-11", "a", "1.0.0"),
        ("third-party/snapshots/2025-11", "a", "2.0.0"),
    }


def test_rig_inventory(spark):
    paths = [
        "third-party/Cargo.toml",
        "third-party/conflict-rigs/sqlx/Cargo.toml",
        "third-party/conflict-rigs/empty/README.md",
        "third-party/snapshots/2025-11/Cargo.toml",
        "third-party/snapshots/2025-11/top/Cargo.toml",
    ]
    files = spark.createDataFrame([(p,) for p in paths], "path STRING")
    assert as_set(SM.rig_inventory(files)) == {
        ("third-party", "main", None),
        ("third-party/conflict-rigs/sqlx", "conflict", None),
        ("third-party/snapshots/2025-11", "snapshot", "2025-11"),
    }


DIRECTIVES = """
buildscript.run = false
cargo_env = ["A", "B"]
extra_deps = ["fixups//win:x.lib", ":tracing"]

['cfg(version = ">=1.0.228")']
buildscript.run = true
cargo_env = true

[['cfg(target_os = "linux")'.cxx_library]]
name = "x"
srcs = ["a.c"]
"""


def test_directives(spark, tmp_path):
    root = write(
        tmp_path,
        {
            "fixups/serde/fixups.toml": DIRECTIVES,
            "fixups/none/fixups.toml": "# nothing\n",
            "fixups/aws/fixups.toml": '[buildscript.run.env]\nOPT = "3"\n',
            "third-party/conflict-rigs/sqlx/fixups/quote/fixups.toml": "buildscript.run = true\n",
        },
    )
    rows = SM.read_fixup_directives(spark, root).persist()
    gated = 'cfg(version = ">=1.0.228")'
    got = as_set(rows)
    assert {r for r in got if r[1] == "serde"} == {
        ("", "serde", 0, None, "buildscript.run", "bool", "false"),
        ("", "serde", 0, None, "cargo_env", "array", '["A", "B"]'),
        ("", "serde", 0, None, "extra_deps", "array", '["fixups//win:x.lib", ":tracing"]'),
        ("", "serde", 1, gated, "buildscript.run", "bool", "true"),
        ("", "serde", 1, gated, "cargo_env", "bool", "true"),
        ("", "serde", 2, 'cfg(target_os = "linux")', "cxx_library", "array", '[{"name": "x", "srcs": ["a.c"]}]'),
    }
    assert ("", "none", 0, None, None, None, None) in got
    assert ("third-party/conflict-rigs/sqlx", "quote", 0, None, "buildscript.run", "bool", "true") in got

    runs = {(r["crate"], r["section_no"]): (r["run"], r["env"]) for r in SM.build_script_view(rows).collect()}
    assert runs == {("serde", 0): (False, None), ("serde", 1): (True, None), ("aws", 0): (True, {"OPT": "3"}), ("quote", 0): (True, None)}
    envs = {r["section_no"]: (r["all_names"], r["names"]) for r in SM.cargo_env_view(rows).collect()}
    assert envs == {0: (False, ["A", "B"]), 1: (True, None)}
    assert {r["label"] for r in SM.extra_dep_view(rows).collect()} == {"fixups//win:x.lib", ":tracing"}
    rows.unpersist()


TARGETS = """# generated
load("@rules//made:up.bzl", "cargo")

http_archive(
    name = "pebble-2.0.0.crate",
    urls = ["https://host/pebble"],
)

cargo.rust_library(
    name = "pebble-2",
    crate = "pebble",
    edition = "2021",
    features = ["default", "std"],
    named_deps = {"twig1": ":twig-0.3"},
    platform = {
        "linux-arm64": dict(
            deps = [":moss-1"],
        ),
        "macos-arm64": dict(
            env = {"A": "1"},
        ),
    },
    deps = [":fern-4", "//other:x"],
)

alias(
    name = "pebble",
    actual = ":pebble-2",
)

buildscript_run(
    name = "pebble-run",
    env = {"LINKS": "stone"},
    version = "2.0.0",
)
"""


def test_target_graph(spark, tmp_path):
    root = write(tmp_path, {"third-party/BUCK": TARGETS})
    targets = ST.read_target_graph(spark, root)
    rows = {r["name"]: r for r in targets.collect()}
    assert {n: r["kind"] for n, r in rows.items()} == {
        "pebble-2.0.0.crate": "http_archive",
        "pebble-2": "cargo.rust_library",
        "pebble": "alias",
        "pebble-run": "buildscript_run",
    }
    library = rows["pebble-2"]
    assert (library["rig"], library["label"]) == ("third-party", "fixups//third-party:pebble-2")
    assert library["features"] == ["default", "std"]
    assert library["platform_deps"] == {"linux-arm64": [":moss-1"], "macos-arm64": []}
    assert rows["pebble-run"]["env"] == {"LINKS": "stone"} and rows["pebble-run"]["version"] == "2.0.0"
    p = "fixups//third-party:"
    assert as_set(ST.target_edges(targets)) == {
        (p + "pebble-2", p + "fern-4", None),
        (p + "pebble-2", "//other:x", None),
        (p + "pebble-2", p + "twig-0.3", None),
        (p + "pebble-2", p + "moss-1", "linux-arm64"),
        (p + "pebble", p + "pebble-2", None),
    }
    stored = str(tmp_path / "targets")
    targets.write.parquet(stored)
    assert ST.read_targets(spark, stored).columns == ["label", "kind"]
    assert ST.read_targets(spark, stored).count() == 4


def test_targets_are_never_evaluated(spark):
    text = """
NAMES = ["a", "b"]
rule(name = __import__("os").getcwd())
rule(name = "a", deps = select({"x": [":y"]}), features = ["f"])
[rule(name = n) for n in NAMES]
[rule(name = n) for n in __import__("os").listdir()]
"""
    targets = ST.parse_targets(spark.createDataFrame([("s", text)], "source STRING, content STRING"))
    assert [(r["name"], r["deps"], r["features"], r["unread"]) for r in targets.collect()] == [
        ("a", [], ["f"], ["deps"]),
        # Items of a literal list are data.
        ("a", [], [], []),
        ("b", [], [], []),
    ]


def test_collection(spark, tmp_path):
    root = write(tmp_path / "fixups", {"serde/fixups.toml": "a", "serde/src/lib.rs": "b", "loose.txt": "c"})
    got = as_set(SS.read_collection(spark, root).select("crate", "path", "content_hash"))
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert got == {("serde", "fixups.toml", digest("a")), ("serde", "src/lib.rs", digest("b"))}


def test_files_that_cannot_be_read_are_rows(spark, tmp_path):
    """One bad file does not end the audit: the others are read, and it is named."""
    root = write(
        tmp_path / "tree",
        {
            "main/Cargo.toml": '[dependencies]\na = "1"\n',
            "bad/Cargo.toml": "[dependencies\n",
            "odd/Cargo.toml": "dependencies = 3\n",
            "main/Cargo.lock": '[[package]]\nname = "a"\nversion = "1.0.0"\n',
            "bad/Cargo.lock": '[[package]]\nname = "a"\n',
            "fixups/a/fixups.toml": "run = true\n",
            "fixups/b/fixups.toml": "run = \n",
            "fixups/c/fixups.toml": "['cfg(unix)'] \nrun = 1\n",
            "main/BUCK": TARGETS,
            "bad/BUCK": "lib(name = \n",
        },
    )
    assert {r["crate"] for r in SM.read_manifest_deps(spark, root).collect()} == {"a"}
    assert as_set(SM.read_lock_packages(spark, root)) == {("main", "a", "1.0.0")}
    assert {r["crate"] for r in SM.read_fixup_directives(spark, root).collect()} == {"a", "c"}
    assert {r["rig"] for r in ST.read_target_graph(spark, root).collect()} == {"main"}
    errors = {r["source"]: r["error"] for r in SM.file_errors(spark, root).collect()}
    assert set(errors) == {"bad/Cargo.toml", "odd/Cargo.toml", "bad/Cargo.lock", "fixups/b/fixups.toml"}
    assert errors["bad/Cargo.lock"].startswith("KeyError")
    assert [r["source"] for r in ST.file_errors(spark, root).collect()] == ["bad/BUCK"]


def test_run_folders(spark, tmp_path):
    good = json.dumps({"results": {"//a:x#lib": {"success": "SUCCESS"}, "//a:y": {}, "//a:z": None}})
    root = write(
        tmp_path / "sweeps",
        {"L/1/r.json": good, "L/1/build.log": "one\r\ntwo", "L/2/r.json": "{}", "L/3/r.json": "", "W/1/deep/r.json": '{"results"', "W/1/n.txt": "x", "W/2/r.json": "[1]"},
    )
    rows = read_run_folders(spark, root)
    assert as_set(rows.where("label IS NULL").select("platform", "run_id", "state")) == {
        ("L", "1", "read"), ("L", "2", "read"), ("L", "3", "unreadable"), ("W", "1", "unreadable"), ("W", "2", "unreadable")
    }
    assert as_set(rows.where("label IS NOT NULL").select("run_id", "label", "success")) == {("1", "//a:x#lib", "SUCCESS"), ("1", "//a:y", None), ("1", "//a:z", None)}
    lines = read_run_folders(spark, root, "lines", ".log")
    assert as_set(lines.select("platform", "run_id", "file", "line_no", "line")) == {("L", "1", "build.log", 1, "one"), ("L", "1", "build.log", 2, "two")}


def test_filters_reach_the_listing(spark, tmp_path):
    root = write(tmp_path / "sweeps", {f"{p}/{r}/r.json": "{}" for p in "LMW" for r in range(40)})
    reader = RunFolderReader(root, "reports", ".json")
    assert len([f for p in reader.partitions() for f in p.folders]) == 120 and len(reader.partitions()) == 4
    left = list(reader.pushFilters([EqualTo(("platform",), "L"), In(("run_id",), ("3", "7", "99")), EqualTo(("label",), "x")]))
    assert [f.attribute for f in left] == [("label",)]
    assert [f[:2] for p in reader.partitions() for f in p.folders] == [("L", "3"), ("L", "7")]
    assert list(reader.pushFilters([EqualTo(("run_id",), "7")])) == []
    assert [f[:2] for p in reader.partitions() for f in p.folders] == [("L", "7")]
    got = read_run_folders(spark, root).where("platform = 'W' AND run_id IN ('5', '6')")
    assert as_set(got.select("platform", "run_id", "state")) == {("W", "5", "read"), ("W", "6", "read")}
    assert "PushedFilters: [EqualTo" in got._jdf.queryExecution().executedPlan().toString() or got.rdd.getNumPartitions() == 1
    assert read_run_folders(spark, root).where("platform = 'X'").count() == 0


def test_one_run_of_many_files_is_read_by_many_tasks(spark, tmp_path):
    folder = tmp_path / "F" / "1"
    (folder / "below").mkdir(parents=True)
    names = [f"r{i}.json" for i in range(40)] + [f"below/{i}.json" for i in range(5)]
    for name in names:
        (folder / name).write_text('{"results": {"fixups//a:%s": null}}' % name)
    (folder / "cut.json").write_text("{")
    rows = read_run_folders(spark, str(tmp_path), shares=16)
    read = rows.where("label IS NOT NULL")
    assert sorted(r["file"] for r in read.collect()) == sorted(names)
    assert read.select(F.spark_partition_id()).distinct().count() > 8
    assert rows.where("label IS NULL").groupBy("state").count().orderBy("state").collect() == [("read", 45), ("unreadable", 1)]


def test_trees_are_written_by_as_many_tasks_as_rows_need(spark, tmp_path, monkeypatch):
    """small rows are not put into one task, files are written where they are read, nulls and an empty table included."""
    from sweepledger.plans import trees

    rows = [(k, k % 3) for k in range(2500)] + [(None, 1), (None, 1), (7, None), (None, None)]
    customers = spark.createDataFrame(rows, "c_custkey long, c_nationkey int")
    customers.write.parquet(f"{tmp_path}/some/customer.parquet")
    customers.limit(0).write.parquet(f"{tmp_path}/none/customer.parquet")
    real, tasks = trees.write_line_files, []

    def write(lines, out):
        tasks.append(lines.rdd.getNumPartitions())
        return real(lines, out)

    monkeypatch.setattr(trees, "write_line_files", write)
    monkeypatch.setattr(trees, "TASK_ROWS", 500)
    got = [tuple(r) for r in trees.resolver_log_tree(spark, f"{tmp_path}/some").collect()]
    want = [("n=0", 7, 1, "error: 7")]
    for nation in range(3):
        for block in range(3):
            keys = [k for k in range(1000 * block, min(2500, 1000 * block + 1000)) if k % 3 == nation]
            want += [(f"n={nation}-{block}", 7, i + 1, f"error: {k}") for i, k in enumerate(keys)]
    assert tasks == [6] and sorted(got) == sorted(want)
    deps = trees.manifest_tree(spark, f"{tmp_path}/some").where("rig = 'n=1-2'")
    assert sorted(r["crate"] for r in deps.collect()) == sorted(f"c{k}" for k in range(2000, 2500) if k % 3 == 1)
    assert trees.resolver_log_tree(spark, f"{tmp_path}/none").count() == 0
