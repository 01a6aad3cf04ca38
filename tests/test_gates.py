"""Gates as clauses, and the coverage of a crate's gates, against brute force."""

import random
import re

import pytest
from frames import as_set

from sweepledger.functions.clauses import clauses_of
from sweepledger.operators import gates as V

PLATFORMS = [("L", "linux", "x86_64", "gnu"), ("M", "macos", "aarch64", None), ("W", "windows", "x86_64", "msvc")]


@pytest.fixture
def table(spark):
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)


def held(spark, gates, versions=("1.2.0",)):
    """``{(gate, version): platforms}`` where the gate holds."""
    where = V.clause_platforms(V.clause_table(spark.createDataFrame([(g,) for g in gates], "gate STRING")), V.platform_attributes(PLATFORMS, spark))
    rows = [(g, p[0], v) for g in gates for p in PLATFORMS for v in versions]
    found = V.holding(V.with_version_key(spark.createDataFrame(rows, "gate STRING, platform STRING, version STRING")), where).collect()
    assert len(found) == len({(r["gate"], r["platform"], r["version"]) for r in found})
    out = {(g, v): set() for g in gates for v in versions}
    for r in found:
        out[r["gate"], r["version"]].add(r["platform"])
    return out


def test_gates_hold(spark):
    gates = {
        'cfg(target_os = "linux")': "L",
        'cfg(all(target_arch = "x86_64", any(target_os = "linux", target_os = "macos")))': "L",
        'cfg(any(target_os = "macos", all(target_os = "windows", target_env = "msvc")))': "MW",
        'cfg(any(all(target_os = "linux", any(target_arch = "arm", target_arch = "x86_64")), target_env = "none"))': "L",
        'cfg(all(version = ">=1", target_os = "linux"))': "L",
        'cfg(all(version = ">=2", target_os = "linux"))': "",
        'cfg(any(version = ">=2", target_os = "linux"))': "L",
        'cfg(any(version = "<1", version = ">=1.2, <1.3"))': "LMW",
        'cfg(all(version = ">=1", version = "<1.2", target_os = "linux"))': "",
        'cfg(version = "<=1.2")': "LMW",
        'cfg(version = ">1.2")': "",
        'cfg(version = "1.1")': "LMW",
        'cfg(version = "=1.2")': "LMW",
        'cfg(target_env = "")': "M",
        "cfg(all())": "LMW",
        "cfg(any())": "",
        None: "LMW",
    }
    assert held(spark, gates) == {(g, "1.2.0"): set(p) for g, p in gates.items()}


def test_gates_that_are_not_understood(spark, table):
    bad = ['cfg(not(target_os = "linux"))', "cfg(unix)", 'cfg(target_family = "unix")', 'cfg(version = "soon")', 'cfg(all(target_os = "a")', 'target_os = "linux"',
           'cfg(target_os = "a", target_os = "b")', "", 'cfg(target_os = "linux"))']
    good = ['cfg(any(version = ">=1", version = "<2"))', 'cfg( all( version = "=1.2",any(target_os = "linux" , target_env="") ) )', None]
    rows = table("crate STRING, gate STRING", *[(f"c{i}", g) for i, g in enumerate(bad + good)])
    assert as_set(V.unread_gates(rows)) == {(f"c{i}", g) for i, g in enumerate(bad)}
    assert all(not p for p in held(spark, bad).values())


def random_gate(rng, depth=3):
    if depth and rng.random() < 0.6:
        parts = [random_gate(rng, depth - 1) for _ in range(rng.randint(0, 3))]
        kind = rng.choice(["all", "any"])
        texts, tests = ", ".join(t for t, _ in parts), [f for _, f in parts]
        return f"{kind}({texts})", (lambda p, v: all(f(p, v) for f in tests)) if kind == "all" else (lambda p, v: any(f(p, v) for f in tests))
    if rng.random() < 0.4:
        low = rng.randrange(4)
        return f'version = ">=1.{low}, <1.{low + 2}"', lambda p, v: low <= v < low + 2
    at = rng.randrange(1, 4)
    value = rng.choice([p[at] or "" for p in PLATFORMS])
    return f'{("target_os", "target_arch", "target_env")[at - 1]} = "{value}"', lambda p, v: (p[at] or "") == value


def test_random_gates(spark):
    rng = random.Random(8)
    gates = {}
    for _ in range(60):
        text, holds = random_gate(rng)
        gates[f"cfg({text})"] = holds
    got = held(spark, gates, [f"1.{v}.0" for v in range(6)])
    assert got == {(g, f"1.{v}.0"): {p[0] for p in PLATFORMS if f(p, v)} for g, f in gates.items() for v in range(6)}
    assert all(clauses_of(g) is not None for g in gates)


def test_gate_of_several_ranges_is_dead_only_as_a_whole(table):
    gates = V.gate_ranges(table("crate STRING, gate STRING", ("a", 'cfg(any(version = "<1", version = "=2.1"))'), ("a", 'cfg(version = "=3")'), ("b", 'cfg(target_os = "x")')))
    resolved = V.with_version_key(table("rig STRING, crate STRING, version STRING", ("r", "a", "2.1.5"), ("r", "a", "4.0.0"), ("r", "b", "1.0.0")))
    assert as_set(V.dead_of_clauses(gates, resolved)) == {("a", 'cfg(version = "=3")')}
    assert [(r["crate"], r["v"]) for r in V.uncovered_versions(resolved, gates).collect()] == [("a", [4, 0, 0])]


def ranges_of(spark, rows):
    bound = lambda x: None if x is None else [x, 0, 0]
    return spark.createDataFrame([(c, bound(lo), bound(hi)) for c, lo, hi in rows], "crate STRING, lo ARRAY<BIGINT>, hi ARRAY<BIGINT>")


def test_coverage_equals_brute_force(spark):
    rng = random.Random(9)
    rows = [(f"c{rng.randrange(12)}", lo, rng.choice([None, lo + rng.randint(0, 6), lo + 1])) for lo in [rng.randrange(40) for _ in range(60)]]
    rows += [("c0", None, 3), ("open", None, None), ("open", 4, 9)]
    points = lambda some: {x for _, lo, hi in some for x in range(lo or 0, 60 if hi is None else hi)}
    gaps, overlaps = V.coverage_gaps(ranges_of(spark, rows)).collect(), V.coverage_overlaps(ranges_of(spark, rows)).collect()
    for crate in {c for c, *_ in rows}:
        own = sorted({r for r in rows if r[0] == crate}, key=str)
        covered = points(own)
        holes = {x for x in range(min(covered, default=0), max(covered, default=0)) if x not in covered}
        assert {x for g in gaps if g["crate"] == crate for x in range(g["lo"][0], g["hi"][0])} == holes
        twice = {x for x in covered if sum(x in points([r]) for r in {(c, lo or 0, hi) for c, lo, hi in own}) > 1}
        assert {x for o in overlaps if o["crate"] == crate for x in range(o["lo"][0], o["hi"][0] if o["hi"] else 60)} == twice


def test_shadowed_sections(table):
    sections = table(
        "crate STRING, key STRING, section_no INT, lo ARRAY<BIGINT>, hi ARRAY<BIGINT>",
        ("a", "k", 0, None, None), ("a", "k", 1, [1, 0, 0], [2, 0, 0]), ("a", "k", 2, [1, 0, 0], [3, 0, 0]), ("a", "k", 3, [2, 0, 0], None),
        ("a", "other", 4, None, None), ("b", "k", 0, [1, 0, 0], [2, 0, 0]), ("b", "k", 1, None, None), ("b", "k", 2, None, [5, 0, 0]),
    )
    assert as_set(V.shadowed_sections(sections)) == {("a", "k", 1), ("b", "k", 0)}


def test_distinct_versions_are_not_hashed_again(spark, tmp_path, monkeypatch):
    """the lines are made distinct by part and number, by as many tasks as they need; their wide keys go through no aggregate."""
    from sweepledger.plans import versions
    from sweepledger.plans.catalog import AUDITS

    monkeypatch.setattr(versions, "TASK_LINES", 4)

    lines = [(1, 5.0), (1, 5.0), (1, 7.0), (1, 7.0), (1, None), (1, None), (1, -1.0), (1, -2.0), (2, 9.0), (3, 1.0), (None, 5.0)]
    spark.createDataFrame(lines, "l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 5), (2, 7), (4, 1), (4, 1)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = AUDITS["uncovered_versions"](spark, str(tmp_path))
    dead = AUDITS["dead_gates"](spark, str(tmp_path))
    for frame in (found, dead):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        keys = [line.split("keys=[")[1].split("]")[0] for line in plan.splitlines() if "Aggregate(keys=[" in line]
        assert "l_partkey" in plan and re.search(r"hashpartitioning\(l_partkey#\w+, major#\w+, 3\), REPARTITION_BY_NUM", plan)
        assert keys and not any(re.search(r"\bv#", k) for k in keys)
    monkeypatch.setattr(versions, "BROADCAST_GATES", 0)
    shuffled = AUDITS["uncovered_versions"](spark, str(tmp_path))
    assert "Broadcast" not in shuffled._jdf.queryExecution().executedPlan().toString()
    for frame in (found, shuffled):
        assert sorted(((r[0], r[1]) for r in frame.collect()), key=str) == [("part-1", 7), ("part-1", None)]
    assert [tuple(r) for r in dead.collect()] == [("part-4", 'cfg(version = ">=1, <6")')] * 2
