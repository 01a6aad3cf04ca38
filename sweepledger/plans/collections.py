"""Copying between collections, and drift.

An order is a crate and its lines are the crate's members: finished lines are the
source, open lines the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import sync as S
from .inputs import table
from .registry import audit

MEMBERS_SQL = """members AS (
    SELECT l_linestatus, l_orderkey AS crate, 'line-' || l_linenumber AS path, CAST(max(l_partkey) AS VARCHAR) AS content_hash
    FROM lineitem GROUP BY l_linestatus, l_orderkey, l_linenumber),
  source AS (SELECT crate, path, content_hash FROM members WHERE l_linestatus = 'F'),
  target AS (SELECT crate, path, content_hash FROM members WHERE l_linestatus = 'O')"""


def _members(spark: SparkSession, root: str, status: str) -> DataFrame:
    lines = table(spark, root, "lineitem").where(F.col("l_linestatus") == status)
    return (
        lines.groupBy("l_orderkey", "l_linenumber")
        .agg(F.max("l_partkey").alias("partkey"))
        .select(
            F.col("l_orderkey").alias("crate"),
            F.concat(F.lit("line-"), "l_linenumber").alias("path"),
            F.col("partkey").cast("string").alias("content_hash"),
        )
    )


def _both(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return _members(spark, root, "F"), _members(spark, root, "O")


@audit(
    "insert_if_absent",
    f"""WITH {MEMBERS_SQL} SELECT * FROM target
    UNION ALL SELECT * FROM source WHERE crate NOT IN (SELECT crate FROM target)""",
)
def insert_if_absent(spark: SparkSession, root: str) -> DataFrame:
    return S.insert_if_absent(*_both(spark, root))


@audit(
    "insert_status",
    f"""WITH {MEMBERS_SQL} SELECT DISTINCT crate,
      CASE WHEN crate IN (SELECT crate FROM target) THEN 'Skipped' ELSE 'Copied' END AS status FROM source""",
)
def insert_status(spark: SparkSession, root: str) -> DataFrame:
    return S.insert_status(*_both(spark, root))


@audit(
    "refresh_matched",
    f"""WITH {MEMBERS_SQL}
    SELECT * FROM source WHERE crate IN (SELECT crate FROM target)
    UNION ALL SELECT * FROM target t WHERE NOT EXISTS (
      SELECT 1 FROM source s WHERE s.crate = t.crate AND s.path = t.path)""",
)
def refresh_matched(spark: SparkSession, root: str) -> DataFrame:
    return S.refresh_matched(*_both(spark, root))


@audit(
    "refresh_status",
    f"""WITH {MEMBERS_SQL} SELECT DISTINCT crate,
      CASE WHEN crate IN (SELECT crate FROM source) THEN 'Copied' ELSE 'NoSource' END AS status FROM target""",
)
def refresh_status(spark: SparkSession, root: str) -> DataFrame:
    return S.refresh_status(*_both(spark, root))


# Drift: parts are records, types are rigs. The regenerated copy has promoted parts
# at another size, lacks the smallest parts, and has one more part per large one.
REGENERATED_SQL = """committed AS (SELECT p_type AS rig, p_partkey AS name, p_size AS size, p_brand AS brand FROM part),
  regenerated AS (
    SELECT p_type AS rig, p_partkey AS name, CASE WHEN p_type = 'PROMO' AND p_size > 40 THEN p_size + 1 ELSE p_size END AS size,
      p_brand AS brand
    FROM part WHERE p_type = 'LARGE' OR p_size > 2
    UNION ALL SELECT p_type, -1 - p_partkey, p_size, p_brand FROM part WHERE p_type = 'SMALL' AND p_size = 50),
  changes AS (
    SELECT rig, name,
      CASE WHEN c.size IS NULL THEN 'added' WHEN r.size IS NULL THEN 'removed'
        WHEN c.size <> r.size OR c.brand <> r.brand THEN 'changed' END AS change
    FROM committed c FULL JOIN regenerated r USING (rig, name))"""


def _drifted(spark: SparkSession, root: str) -> DataFrame:
    parts = table(spark, root, "part").select(
        F.col("p_type").alias("rig"), F.col("p_partkey").alias("name"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand")
    )
    bigger = F.when((F.col("rig") == "PROMO") & (F.col("size") > 40), F.col("size") + 1).otherwise(F.col("size"))
    kept = parts.where((F.col("rig") == "LARGE") | (F.col("size") > 2)).withColumn("size", bigger)
    added = parts.where("rig = 'SMALL' AND size = 50").withColumn("name", -1 - F.col("name"))
    return D.drift_records(parts, kept.unionByName(added), ["rig", "name"], ["size", "brand"])


@audit("drift", f"WITH {REGENERATED_SQL} SELECT rig, name, change FROM changes WHERE change IS NOT NULL")
def drift(spark: SparkSession, root: str) -> DataFrame:
    return _drifted(spark, root).select("rig", "name", "change")


@audit(
    "drift_counts",
    f"""WITH {REGENERATED_SQL} SELECT rig, count(*) FILTER (change = 'added') AS added,
      count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed
    FROM changes WHERE change IS NOT NULL GROUP BY rig""",
)
def drift_counts(spark: SparkSession, root: str) -> DataFrame:
    return D.drift_counts(_drifted(spark, root))


# Customers are rigs: the digest is the largest order, committed by 1998; the tool
# fails where the balance is negative; pending orders of the last years are output.
RIG_STATUS_SQL = """made AS (SELECT o_custkey AS rig, max(o_orderkey) AS h FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
  kept AS (SELECT o_custkey AS rig, max(o_orderkey) AS h FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_orderstatus <> 'P' GROUP BY 1),
  drifted AS (
    SELECT rig, CASE WHEN kept.h IS NULL THEN 'new' WHEN kept.h = made.h THEN 'same' ELSE 'stale' END AS status
    FROM made LEFT JOIN kept USING (rig)),
  spoke AS (SELECT DISTINCT o_custkey AS rig FROM orders WHERE o_orderstatus = 'P'),
  judged AS (
    SELECT c_custkey AS rig,
      CASE WHEN c_acctbal < 0 THEN 'tool failed'
        WHEN c_custkey IN (SELECT rig FROM spoke) THEN 'not clean'
        WHEN c_custkey IN (SELECT rig FROM drifted WHERE status = 'stale') THEN 'stale' END AS reason
    FROM customer),
  statuses AS (SELECT rig, reason IS NOT NULL AS failed, reason FROM judged)"""


def _files(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders").where("o_orderstatus <> 'P'")
    last = F.max("o_orderkey").cast("string").alias("content_hash")

    def digest(part: DataFrame) -> DataFrame:
        return part.groupBy(F.col("o_custkey").alias("rig")).agg(last)

    return D.drift_of_files(digest(orders.where("o_orderdate < timestamp_ntz '1998-01-01 00:00:00'")), digest(orders))


def _rigs(spark: SparkSession, root: str) -> DataFrame:
    runs = table(spark, root, "customer").select(F.col("c_custkey").alias("rig"), (F.col("c_acctbal") < 0).alias("tool_failed"))
    output = table(spark, root, "orders").where("o_orderstatus = 'P'")
    return D.rig_status(runs, output.select(F.col("o_custkey").alias("rig"), F.col("o_orderpriority").alias("line")), _files(spark, root))


@audit("drift_of_files", f"WITH {RIG_STATUS_SQL} SELECT rig, status FROM drifted")
def drift_of_files(spark: SparkSession, root: str) -> DataFrame:
    return _files(spark, root)


@audit("rig_status", f"WITH {RIG_STATUS_SQL} SELECT * FROM statuses")
def rig_status(spark: SparkSession, root: str) -> DataFrame:
    return _rigs(spark, root)


@audit(
    "overall_status",
    f"""WITH {RIG_STATUS_SQL} SELECT count(*) AS n_rigs, count(*) FILTER (failed) AS n_failed, bool_or(failed) AS failed
    FROM statuses""",
)
def overall_status(spark: SparkSession, root: str) -> DataFrame:
    return D.overall_status(_rigs(spark, root))
