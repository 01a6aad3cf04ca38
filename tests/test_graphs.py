"""Closures per platform, causes, and pruning by version ranges and conflicts, against brute force."""

import random

import pytest
from frames import as_set

from sweepledger.operators import graph as G
from sweepledger.operators import manifests as M
from sweepledger.operators import propagate as P


@pytest.fixture
def table(spark):
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)


EDGE, SEED = "src STRING, dst STRING, platform STRING", "platform STRING, node STRING"


def slow_closure(edges, seeds, platforms):
    """``{(platform, node): (depth, cause, via)}`` by breadth-first search, one platform after the other."""
    out = {}
    for name, others in platforms.items():
        own = {(s, d) for s, d, p in edges if p is None or p in (name, *others)}
        now = {n: (n, None) for p, n in seeds if p == name}
        depth = 0
        while now:
            out.update({(name, n): (depth, *way) for n, way in now.items()})
            ways = {}
            for s, d in own:
                if d in now and (name, s) not in out:
                    ways.setdefault(s, []).append((now[d][0], d))
            now, depth = {s: min(w) for s, w in ways.items()}, depth + 1
    return out


@pytest.mark.parametrize("limit, n_platforms", [(1 << 25, 3), (0, 3), (1 << 25, 130)])
def test_closure_by_platform(spark, monkeypatch, limit, n_platforms):
    """Every platform at once equals one after the other; 130 platforms take three numbers."""
    monkeypatch.setattr(P, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(P, "COMPACT_EVERY", 2)
    rng = random.Random(n_platforms)
    platforms = {f"p{i}": (f"alias{i}", f"both{i % 2}") for i in range(n_platforms)}
    named = [None, None, *platforms, "unlisted", *(o for others in platforms.values() for o in others)]
    node = lambda: f"n{rng.randrange(40)}"
    edges = [(node(), node(), rng.choice(named)) for _ in range(90)]
    seeds = [(rng.choice([*platforms, "unlisted", None]), node()) for _ in range(12)]
    want = slow_closure(edges, seeds, platforms)
    e, s = spark.createDataFrame(edges, EDGE), spark.createDataFrame(seeds, SEED)
    assert as_set(G.closure_by_platform(e, s, platforms)) == {(*k, v[0]) for k, v in want.items()}
    if n_platforms < 10:
        causes = G.causes_by_platform(e, s, platforms)
        assert as_set(causes) == {(*k, *v) for k, v in want.items()}
        counts = {}
        for (platform, _), (depth, cause, _) in want.items():
            n, deepest = counts.get((platform, cause), (0, 0))
            counts[platform, cause] = (n + (depth > 0), max(deepest, depth))
        assert as_set(G.root_counts(causes)) == {(*k, *v) for k, v in counts.items()}
    others = {r["platform"]: (r["n_edges"], r["n_seeds"]) for r in G.unlisted_platforms(e, s, platforms).collect()}
    assert others.get("unlisted", (0, 0)) == (sum(p == "unlisted" for *_, p in edges), sum(p == "unlisted" for p, _ in seeds))


def test_a_failure_of_one_platform_breaks_nothing_elsewhere(table):
    edges = table(EDGE, ("app", "lib", None), ("lib", "win", "windows-msvc"), ("lib", "base", None))
    seeds = table(SEED, ("Windows-x86_64", "win"), ("Linux-x86_64", "base"))
    names = {"Windows-x86_64": ("windows-msvc",), "Linux-x86_64": ()}
    assert as_set(G.closure_by_platform(edges, seeds, names)) == {
        ("Windows-x86_64", "win", 0), ("Windows-x86_64", "lib", 1), ("Windows-x86_64", "app", 2),
        ("Linux-x86_64", "base", 0), ("Linux-x86_64", "lib", 1), ("Linux-x86_64", "app", 2),
    }
    assert G.closure_by_platform(edges, seeds.limit(0), names).count() == 0
    assert G.causes_by_platform(edges.limit(0), seeds, names).count() == 2


def allowed(requirement, version):
    """The rule of requirements, comparison by comparison, on a list of three numbers."""
    for piece in requirement.split(","):
        piece = piece.strip()
        if piece in ("*", ""):
            continue
        operator = next((o for o in (">=", "<=", ">", "<", "=", "^", "~") if piece.startswith(o)), "")
        parts = piece[len(operator) :].strip().split(".")
        wild = "*" in parts
        given = [int(p) for p in parts if p != "*"]
        prefix, whole = version[: len(given)], given + [0] * (3 - len(given))
        if wild or operator == "=":
            ok = prefix == given
        elif operator == "~":
            ok = version >= whole and version[: min(2, len(given))] == given[:2]
        elif operator in ("", "^"):
            keep = next((i for i, n in enumerate(given) if n), len(given) - 1) + 1
            ok = version >= whole and version[:keep] == whole[:keep]
        else:
            ok = {">=": prefix >= given, ">": prefix > given, "<=": prefix <= given, "<": prefix < given}[operator]
        if not ok:
            return False
    return True


def requirements(rng, n):
    def one():
        numbers = [str(rng.randrange(3)) for _ in range(rng.randint(1, 3))]
        operator = rng.choice(["", "^", "~", "=", ">", ">=", "<", "<="])
        return operator + rng.choice(["", " "]) + ".".join(numbers) if rng.random() < 0.9 else ".".join([*numbers[:2], "*"])

    return [rng.choice([one(), one(), f"{one()}, {one()}", "*"]) for _ in range(n)]


def test_requirement_ranges_hold_the_same_versions(spark):
    rng = random.Random(4)
    texts = sorted(set(requirements(rng, 150)))
    versions = [[a, b, c] for a in range(4) for b in range(4) for c in range(4)]
    frame = spark.createDataFrame([("s", "x", t) for t in texts], "slot STRING, crate STRING, version_req STRING")
    for row in M.with_range(frame).collect():
        inside = [v for v in versions if (row["lo"] is None or v >= row["lo"]) and (row["hi"] is None or v < row["hi"])]
        assert row["read"] and inside == [v for v in versions if allowed(row["version_req"], v)], row["version_req"]


def test_requirement_texts(table):
    given = ["1.2.3-rc.1", "=1.2.3-rc.1", "<1.2.3-rc.1", "1.0.0+b.1", "latest", "1.2.3.4", ">=1, what", None]
    got = M.with_range(table("version_req STRING", *[(g,) for g in given])).collect()
    told = {r["version_req"]: (r["lo"], r["hi"], r["read"]) for r in got}
    assert told["1.2.3-rc.1"] == ([1, 2, 3], [2, 0, 0], True) and told["=1.2.3-rc.1"] == ([1, 2, 3], [1, 2, 3], True)
    assert told["<1.2.3-rc.1"] == (None, [1, 2, 3], True) and told["1.0.0+b.1"] == ([1, 0, 0], [2, 0, 0], True)
    assert all(not told[t][2] and told[t][0] > told[t][1] for t in ("latest", "1.2.3.4", ">=1, what"))
    assert told[None] == (None, None, None)
    unread = M.unread_requirements(table("slot STRING, crate STRING, version_req STRING", *[("s", "c", g) for g in given]))
    assert {r["version_req"] for r in unread.collect()} == {"latest", "1.2.3.4", ">=1, what"}


def test_latest_in_range(table):
    index = table(
        "crate STRING, version STRING, slot STRING, yanked BOOLEAN",
        ("a", "1.0.9", "1", False), ("a", "1.0.27", "3", False), ("a", "1.1.0", "2", True), ("a", "2.0.0", "2", False),
        ("a", "2.1.0-rc.1", "1", False), ("b", "0.1.0", "2", False),
    )
    asked = table("crate STRING, version_req STRING", ("a", "^1"), ("a", "*"), ("a", ">3"), ("b", "0.1"), ("gone", "*"))
    assert as_set(M.latest_in_range(index, asked, ["1", "2", "3"])) == {
        ("1", "a", "^1", "1.0.9"), ("2", "a", "^1", "1.0.9"), ("3", "a", "^1", "1.0.27"),
        ("1", "a", "*", "1.0.9"), ("2", "a", "*", "2.0.0"), ("3", "a", "*", "2.0.0"),
        ("2", "b", "0.1", "0.1.0"), ("3", "b", "0.1", "0.1.0"),
    }


def slow_versions(candidates, asked):
    alive, out, n = set(candidates), {}, 0
    while True:
        n += 1
        down = set()
        for slot, crate, version, needs, text in asked:
            if not any(s == slot and c == needs and allowed(text, list(map(int, v.split(".")))) for s, c, v in alive):
                down |= {(s, c, v) for s, c, v in alive if (s, c) == (slot, crate) and version in (None, v)}
        if not down:
            return out
        out.update(dict.fromkeys(down, n))
        alive -= down


@pytest.mark.parametrize("seed, compact", [(1, 16), (2, 1)])
def test_pruned_versions_equal_brute_force(spark, monkeypatch, seed, compact):
    monkeypatch.setattr(M, "COMPACT_EVERY", compact)
    rng = random.Random(seed)
    candidates = [(s, f"c{c}", f"{rng.randrange(3)}.{rng.randrange(3)}.0") for s in "st" for c in range(25) for _ in range(rng.randint(1, 4))]
    texts = requirements(rng, 110)
    asked = [(rng.choice("st"), f"c{rng.randrange(25)}", None, f"c{rng.randrange(27)}", t) for t in texts]
    asked = [(s, c, rng.choice([None, *(v for a, b, v in candidates if (a, b) == (s, c))]), n, t) for s, c, _, n, t in asked]
    want = slow_versions(candidates, asked)
    held = spark.createDataFrame(candidates, "slot STRING, crate STRING, version STRING")
    needs = spark.createDataFrame(asked, "slot STRING, crate STRING, version STRING, needs STRING, version_req STRING")
    fallen = M.prune_versions(held, needs)
    assert as_set(fallen) == {(*k, n) for k, n in want.items()} and len(set(want.values())) > 2
    lost = {}
    for s, c, v in set(candidates):
        lost.setdefault((s, c), []).append(want.get((s, c, v)))
    assert as_set(M.lost_crates(held, fallen)) == {(*k, max(n)) for k, n in lost.items() if None not in n}
    assert M.prune_versions(held.limit(0), needs).count() == 0 and M.prune_versions(held, needs.limit(0)).count() == 0
    with pytest.raises(P.RoundsExceeded):
        M.prune_versions(held, needs, max_rounds=1)


def test_large_rounds_of_versions_do_not_pass_through_the_driver(spark, monkeypatch):
    plans = []

    def noting(write):
        def noted(df, *args):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return write(df, *args)

        return noted

    monkeypatch.setattr(M, "stage", noting(M.stage))
    monkeypatch.setattr(M, "stage_at", noting(M.stage_at))
    monkeypatch.setattr(M, "BROADCAST_ROWS", -1, raising=False)  # not even no rows
    held = spark.createDataFrame([("s", c, "1.0.0") for c in "abcd"], "slot STRING, crate STRING, version STRING")
    asked = [("s", "a", "x", "*"), ("s", "b", "a", "*"), ("s", "c", "b", "^1"), ("s", "d", "d", "*")]
    needs = spark.createDataFrame(asked, "slot STRING, crate STRING, needs STRING, version_req STRING")
    lost = M.lost_crates(held, M.prune_versions(held, needs))
    plans.append(lost._jdf.queryExecution().executedPlan().toString())
    assert as_set(lost) == {("s", "a", 1), ("s", "b", 2), ("s", "c", 3)}
    assert len(plans) > 10 and [p[:1200] for p in plans if "BroadcastExchange" in p] == []


def slow_conflicts(members, needs, conflicts):
    """Drops by rounds: to rest, then the conflicts that come first, and so on."""
    alive = {c for c, ok in members if ok}
    out = {c: 1 for c, ok in members if not ok}
    out.update({c: 1 for c, n in needs if n not in dict(members)})
    wave, n = set(out), 1

    def follow(wave, n):
        while wave:
            n += 1
            wave = {c for c, d in needs if d in wave and c not in out and c in alive}
            out.update(dict.fromkeys(wave, n))

    follow(wave, n)
    while True:
        live = {i: sorted(r) for i, r in conflicts.items() if len(r) > 1 and all(c in dict(members) and c not in out for _, c in r)}
        order = {i: (*r[0], i) for i, r in live.items()}
        first = [i for i in live if all(order[i] <= order[j] for j in live if {c for _, c in live[i]} & {c for _, c in live[j]})]
        if not first:
            return out
        n = max(out.values(), default=0) + 1
        wave = {live[i][0][1] for i in first}
        out.update(dict.fromkeys(wave, n))
        follow(wave, n)


@pytest.mark.parametrize("seed", range(3))
def test_conflicts_are_judged_again(spark, seed):
    rng = random.Random(seed)
    members = [(f"c{i}", rng.random() > 0.1) for i in range(40)]
    needs = [(f"c{rng.randrange(40)}", f"c{rng.randrange(40)}") for _ in range(25)]
    conflicts = {i: {(rng.randrange(6), f"c{rng.randrange(41)}") for _ in range(rng.randint(1, 3))} for i in range(18)}
    conflicts = {i: {(min(m for m, d in r if d == c), c) for _, c in r} for i, r in conflicts.items()}
    frames = (
        spark.createDataFrame([("s", *m) for m in members], "slot STRING, crate STRING, available BOOLEAN"),
        spark.createDataFrame([("s", *n) for n in needs], "slot STRING, crate STRING, needs STRING"),
        spark.createDataFrame([("s", i, m, c) for i, r in conflicts.items() for m, c in r], "slot STRING, conflict_id INT, line_no INT, crate STRING"),
    )
    got = {r["crate"]: r["round"] for r in M.prune_to_consistent(*frames).collect()}
    assert got == slow_conflicts(members, needs, conflicts)


def test_a_conflict_lapses(table):
    """``b`` is gone before the conflict is judged, so ``a`` stays; the other conflict still costs one."""
    members = table("slot STRING, crate STRING, available BOOLEAN", *[("s", c, c != "x") for c in "abcdx"])
    needs = table("slot STRING, crate STRING, needs STRING", ("s", "b", "x"))
    conflicts = table("slot STRING, conflict_id INT, line_no INT, crate STRING", ("s", 1, 1, "a"), ("s", 1, 1, "b"), ("s", 2, 9, "c"), ("s", 2, 9, "d"))
    assert as_set(M.prune_to_consistent(members, needs, conflicts)) == {("s", "x", 1), ("s", "b", 2), ("s", "c", 3)}


def test_prunings_together(table):
    """A lost crate frees a conflict, and a crate dropped by a conflict takes versions with it."""
    members = table("slot STRING, crate STRING", *[("s", c) for c in ("app", "old", "a", "b", "user")])
    candidates = table("slot STRING, crate STRING, version STRING", *[("s", c, v) for c in ("app", "a", "b", "user") for v in ("1.0.0", "2.0.0")], ("s", "old", "1.0.0"))
    needs = table(
        "slot STRING, crate STRING, version STRING, needs STRING, version_req STRING",
        ("s", "old", None, "app", "^3"), ("s", "app", "2.0.0", "old", "*"), ("s", "user", "2.0.0", "a", "*"), ("s", "user", None, "app", "^1"),
    )
    conflicts = table("slot STRING, conflict_id INT, line_no INT, crate STRING", ("s", 1, 1, "old"), ("s", 1, 2, "b"), ("s", 2, 3, "a"), ("s", 2, 4, "b"))
    dropped, left = M.prune_resolved(members, candidates, needs, conflicts)
    assert {r["crate"] for r in dropped.collect()} == {"old", "a"}
    assert as_set(left) == {("s", "app", "1.0.0"), ("s", "b", "1.0.0"), ("s", "b", "2.0.0"), ("s", "user", "1.0.0")}
