"""One key holds a third of all rows: results stay whole and the key is split.

Broadcasts are off and the limits of adaptive execution are lowered, so that small
tables are treated as large ones are.
"""

import random

import pytest
from frames import as_set

from sweepledger.fixed_values import CANCEL_TEXT
from sweepledger.operators import gates as V
from sweepledger.operators import impact as I
from sweepledger.operators import propagate as P
from sweepledger.operators import reconcile as R
from sweepledger.operators import setops as O
from sweepledger.operators import sync as S

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4096",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8192",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1",
}
ROWS = 9000


@pytest.fixture(autouse=True)
def large(spark):
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key in SETTINGS:
        spark.conf.unset(key)


@pytest.fixture
def keys():
    """A third of the rows have the key ``hot``."""
    rng = random.Random(11)
    return ["hot" if i % 3 == 0 else f"k{rng.randrange(400)}" for i in range(ROWS)]


def spread_rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(8)


def final_plan(frame):
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.split("Initial Plan")[0]


def test_gate_matches(spark, keys):
    resolved = V.with_version_key(spread_rows(spark, [(i, k, f"1.{i % 50}.0") for i, k in enumerate(keys)], "id INT, crate STRING, version STRING"))
    names = sorted(set(keys))
    gates = V.with_bounds(spread_rows(spark, [(k, f'cfg(version = ">=1.{n}, <1.{n + 20}")') for k in names for n in (0, 25)], "crate STRING, gate STRING"))
    matches = V.gate_matches(resolved, gates)
    assert "skew=true" in final_plan(matches)
    want = {(i, f'cfg(version = ">=1.{n}, <1.{n + 20}")') for i, _ in enumerate(keys) for n in (0, 25) if n <= i % 50 < n + 20}
    assert as_set(matches.select("id", "gate")) == want


def test_sync(spark, keys):
    source = spread_rows(spark, [(k, f"p{i}", "s") for i, k in enumerate(keys)], "crate STRING, path STRING, content_hash STRING")
    target = spread_rows(spark, [(k, f"p{i}", "t") for i, k in enumerate(keys) if k not in ("hot", "k1", "k2")][::2], "crate STRING, path STRING, content_hash STRING")
    inserted = S.insert_if_absent(source, target)
    assert "skew=true" in final_plan(inserted)
    rows_s, rows_t = as_set(source), as_set(target)
    held = {r[0] for r in rows_t}
    assert as_set(inserted) == rows_t | {r for r in rows_s if r[0] not in held}
    fresh = {r[:2]: r for r in rows_t} | {r[:2]: r for r in rows_s if r[0] in held}
    assert as_set(S.refresh_matched(source, target)) == set(fresh.values())


def test_spread_through_a_hot_node(spark, keys, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_BYTES", 0)
    edges = spread_rows(spark, [(f"n{i}", k) for i, k in enumerate(keys)], "src STRING, dst STRING")
    seeds = spark.createDataFrame([("hot",), ("k7",)], "node STRING")
    got = P.spread(edges, seeds)
    want = {("hot", 0), ("k7", 0)} | {(f"n{i}", 1) for i, k in enumerate(keys) if k in ("hot", "k7")}
    assert as_set(got) == want


def test_cancelled_hot_run(spark, keys):
    reports = spread_rows(spark, [(k, "L", f"l{i}") for i, k in enumerate(keys)], "run_id STRING, platform STRING, label STRING")
    logs = spread_rows(spark, [(k, "L", CANCEL_TEXT if k < "k2" and k != "hot" else "") for k in keys], "run_id STRING, platform STRING, line STRING")
    kept = R.drop_cancelled(reports, logs)
    assert "skew=true" in final_plan(kept)
    assert as_set(kept) == {(k, "L", f"l{i}") for i, k in enumerate(keys) if not (k < "k2" and k != "hot")}


def test_known_broken_hot_stem(spark, keys):
    candidates = spread_rows(spark, [(f"p:{k}-{i}",) for i, k in enumerate(keys)], "label STRING")
    known = spread_rows(spark, [(f"p:k{i}-1",) for i in range(200)], "label STRING")
    kept = I.drop_known_broken(candidates, known)
    assert "skew=true" in final_plan(kept)
    assert as_set(kept) == {(f"p:{k}-{i}",) for i, k in enumerate(keys) if k == "hot" or int(k[1:]) >= 200}


def test_a_small_round_does_not_shuffle_the_seen(spark):
    """The candidates go to where the nodes seen lie; the large side has no exchange above it."""
    seen = spark.range(100_000).selectExpr("concat('n', id) AS node")
    candidates = P._Table(spark.createDataFrame([("n5",), ("new",)], "node STRING"), ["node"], "candidates")
    fresh = P._unseen(candidates, seen, ["node"])
    assert as_set(fresh) == {("new",)}
    assert "Exchange hashpartitioning" not in final_plan(fresh)


@pytest.mark.parametrize("most", [0, 1 << 25])
def test_a_deep_chain_is_followed_to_its_end(spark, monkeypatch, most):
    monkeypatch.setattr(P, "BROADCAST_BYTES", most)
    """Past the rounds kept apart, with and without broadcasts."""
    depth = P.COMPACT_EVERY + 4
    edges = spark.createDataFrame([(i + 1, i) for i in range(depth)], "src INT, dst INT")
    seeds = spark.createDataFrame([(0,)], "node INT")
    assert as_set(P.spread(edges, seeds)) == {(i, i) for i in range(depth + 1)}


def test_two_sided_sets_collapse_before_the_shuffle(spark, keys):
    observed = spread_rows(spark, [("L", k) for k in keys], "platform STRING, label STRING")
    known = spread_rows(spark, [("L", k) for k in keys if k != "k3"], "platform STRING, label STRING")
    statuses = R.reconcile(observed, known)
    assert final_plan(statuses).count("partial_max") == 2
    assert as_set(statuses) == {("L", k, "new" if k == "k3" else "known") for k in keys}
