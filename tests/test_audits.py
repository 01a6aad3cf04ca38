"""Every audit against its SQL, and the shape of its plan."""

import pytest
from oracle import compare, connect

from sweepledger.plans.catalog import AUDITS, ORACLES


@pytest.fixture(scope="module")
def connection(testdata):
    return connect(testdata)


def test_every_audit_has_sql():
    assert set(AUDITS) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(AUDITS))
def test_audit_equals_sql(spark, connection, testdata, name):
    assert compare(spark, connection, testdata, AUDITS[name], ORACLES[name]) is None


LOOPS = {"dependents_closure", "blast_radius", "prune_to_consistent", "pruned_list", "prune_slots", "closure_by_platform", "nearest_causes", "root_counts", "prune_versions", "lost_crates"}


@pytest.mark.parametrize("name", sorted(set(AUDITS) - LOOPS))
def test_plan_has_no_pairwise_join(spark, testdata, name):
    """With broadcasts switched off, as for large tables, every join has an equi-key."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = AUDITS[name](spark, testdata)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "BroadcastExchange" not in plan


def test_entry(spark):
    import __spark_entry__ as entry

    frame = entry.entry(spark)
    assert frame.columns == ["label", "status"] and frame.count() > 0


def test_golden_counts(spark):
    """Counts both engines agreed on before any of this was written."""
    root = "/root/testdata/sf0.01"
    counts = {r["status"]: r["count"] for r in AUDITS["reconcile_status"](spark, root).groupBy("status").count().collect()}
    assert counts == {"new": 27, "stale": 8, "known": 1851}
    assert AUDITS["gate_matches"](spark, root).count() == 5267
    assert AUDITS["last_section"](spark, root).count() == 6470
    rounds = AUDITS["prune_to_consistent"](spark, root).groupBy("round").count().orderBy("round").collect()
    assert [r["count"] for r in rounds] == [122, 113, 84, 99, 143, 165, 113, 56]
