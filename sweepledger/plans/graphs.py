"""Dependency graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import manifests as M
from .inputs import table
from .registry import audit

# Each customer depends on two others with smaller keys; key 0 depends on itself.
EDGES_SQL = """edges AS (
    SELECT c_custkey AS src, c_custkey // 3 AS dst FROM customer
    UNION SELECT c_custkey, c_custkey // 7 FROM customer)"""


def _edges(spark: SparkSession, root: str) -> DataFrame:
    keys = table(spark, root, "customer").select("c_custkey")
    both = F.explode(F.array_distinct(F.array(F.expr("c_custkey div 3"), F.expr("c_custkey div 7"))))
    return keys.select(F.col("c_custkey").alias("src"), both.alias("dst"))


@audit(
    "dependents_closure",
    f"""WITH RECURSIVE {EDGES_SQL}, closure(node) AS (
      SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_acctbal > 5000
      UNION SELECT src FROM closure JOIN edges ON dst = node)
    SELECT node FROM closure""",
)
def dependents_closure(spark: SparkSession, root: str) -> DataFrame:
    seeds = table(spark, root, "customer").where("c_nationkey = 3 AND c_acctbal > 5000")
    return G.dependents_closure(_edges(spark, root), seeds.select(F.col("c_custkey").alias("node"))).select("node")


# Suppliers in debt break the parts they deliver, those the orders with them, those
# the customers; countries and regions stand below the suppliers.
BLAST_SQL = """edges AS (
    SELECT DISTINCT 'part-' || l_partkey AS src, 'supplier-' || l_suppkey AS dst FROM lineitem WHERE l_returnflag = 'R'
    UNION SELECT DISTINCT 'order-' || l_orderkey, 'part-' || l_partkey FROM lineitem
    UNION SELECT 'customer-' || o_custkey, 'order-' || o_orderkey FROM orders
    UNION SELECT 'supplier-' || s_suppkey, 'nation-' || s_nationkey FROM supplier),
  seeds AS (
    SELECT 'supplier-' || s_suppkey AS node FROM supplier WHERE s_acctbal < -500
    UNION SELECT 'nation-' || n_nationkey FROM nation WHERE n_regionkey = 2)"""


def _named(kind: str, key: str):
    return F.concat(F.lit(f"{kind}-"), F.col(key))


def _links(df: DataFrame, src: tuple[str, str], dst: tuple[str, str]) -> DataFrame:
    """Distinct on the numbers, before they become longer texts."""
    return df.select(src[1], dst[1]).distinct().select(_named(*src).alias("src"), _named(*dst).alias("dst"))


def _delivery_edges(spark: SparkSession, root: str) -> DataFrame:
    lines = table(spark, root, "lineitem")
    return (
        _links(lines.where("l_returnflag = 'R'"), ("part", "l_partkey"), ("supplier", "l_suppkey"))
        .unionByName(_links(lines, ("order", "l_orderkey"), ("part", "l_partkey")))
        .unionByName(
            _links(table(spark, root, "orders"), ("customer", "o_custkey"), ("order", "o_orderkey"))
        )
        .unionByName(_links(table(spark, root, "supplier"), ("supplier", "s_suppkey"), ("nation", "s_nationkey")))
    )


@audit(
    "blast_radius",
    f"""WITH RECURSIVE {BLAST_SQL}, closure(node, depth) AS (
      SELECT node, 0 FROM seeds
      UNION SELECT src, depth + 1 FROM closure JOIN edges ON dst = node)
    SELECT node, min(depth) AS depth FROM closure GROUP BY node""",
)
def blast_radius(spark: SparkSession, root: str) -> DataFrame:
    suppliers = table(spark, root, "supplier").where("s_acctbal < -500").select(_named("supplier", "s_suppkey").alias("node"))
    nations = table(spark, root, "nation").where("n_regionkey = 2").select(_named("nation", "n_nationkey").alias("node"))
    return G.dependents_closure(_delivery_edges(spark, root), suppliers.unionByName(nations))


# Customers again, with platforms: the second dependency holds on one of them only, and each nation's failures are on the list of one.
PLATFORM_SQL = """edges AS (
    SELECT c_custkey AS src, c_custkey // 3 AS dst, CAST(NULL AS VARCHAR) AS platform FROM customer
    UNION SELECT c_custkey, c_custkey // 7, 'os-' || (c_custkey % 4) FROM customer),
  seeds AS (SELECT 'p' || (c_nationkey % 3) AS platform, c_custkey AS node FROM customer WHERE c_acctbal > 9000),
  names(platform, other) AS (VALUES ('p0', 'os-0'), ('p1', 'os-1'), ('p2', 'os-2')),
  own_edges AS (SELECT names.platform, src, dst FROM edges JOIN names ON edges.platform IS NULL OR edges.platform = other),
  closure(platform, node, depth) AS (
    SELECT platform, node, 0 FROM seeds
    UNION SELECT e.platform, src, depth + 1 FROM closure c JOIN own_edges e ON dst = c.node AND e.platform = c.platform AND src <> dst),
  broken AS (SELECT platform, node, min(depth) AS depth FROM closure GROUP BY platform, node),
  causes(platform, node, depth, cause, via) AS (
    SELECT platform, node, 0, node, NULL::BIGINT FROM broken WHERE depth = 0
    UNION ALL
    SELECT platform, node, depth, way.cause, way.via FROM (
      SELECT b.platform, b.node, b.depth, min({'cause': c.cause, 'via': c.node}) AS way
      FROM causes c JOIN own_edges e ON e.dst = c.node AND e.platform = c.platform
        JOIN broken b ON b.node = e.src AND b.platform = c.platform AND b.depth = c.depth + 1
      GROUP BY b.platform, b.node, b.depth))"""
LISTED = {"p0": ("os-0",), "p1": ("os-1",), "p2": ("os-2",)}


def _gated(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    customers = table(spark, root, "customer")
    always = customers.select(F.col("c_custkey").alias("src"), F.expr("c_custkey div 3").alias("dst"), F.lit(None).cast("string").alias("platform"))
    some = customers.select("c_custkey", F.expr("c_custkey div 7"), F.concat(F.lit("os-"), F.col("c_custkey") % 4))
    seeds = customers.where("c_acctbal > 9000").select(F.concat(F.lit("p"), F.col("c_nationkey") % 3).alias("platform"), F.col("c_custkey").alias("node"))
    return always.union(some), seeds


@audit("closure_by_platform", f"WITH RECURSIVE {PLATFORM_SQL} SELECT platform, node, CAST(depth AS INTEGER) AS depth FROM broken")
def closure_by_platform(spark: SparkSession, root: str) -> DataFrame:
    return G.closure_by_platform(*_gated(spark, root), LISTED)


@audit("nearest_causes", f"WITH RECURSIVE {PLATFORM_SQL} SELECT platform, node, CAST(depth AS INTEGER) AS depth, cause, via FROM causes")
def nearest_causes(spark: SparkSession, root: str) -> DataFrame:
    return G.causes_by_platform(*_gated(spark, root), LISTED)


@audit(
    "root_counts",
    f"""WITH RECURSIVE {PLATFORM_SQL} SELECT platform, cause, count(*) FILTER (depth > 0) AS n_explained,
      CAST(max(depth) AS INTEGER) AS deepest FROM causes GROUP BY platform, cause""",
)
def root_counts(spark: SparkSession, root: str) -> DataFrame:
    return G.root_counts(G.causes_by_platform(*_gated(spark, root), LISTED))


@audit(
    "unlisted_platforms",
    f"""WITH RECURSIVE {PLATFORM_SQL} SELECT 'os-3' AS platform, count(*) AS n_edges, CAST(0 AS BIGINT) AS n_seeds
    FROM customer WHERE c_custkey % 4 = 3 HAVING count(*) > 0""",
)
def unlisted_platforms(spark: SparkSession, root: str) -> DataFrame:
    return G.unlisted_platforms(*_gated(spark, root), LISTED)


@audit(
    "dangling_labels",
    """SELECT coalesce(l.k, p.k) AS label, CASE WHEN p.k IS NULL THEN 'dangling' ELSE 'unreferenced' END AS problem
    FROM (SELECT DISTINCT 'part-' || l_partkey || '-' || (l_suppkey % 10) AS k FROM lineitem) l
    FULL JOIN (SELECT 'part-' || p_partkey || '-' || (p_size % 10) AS k FROM part) p ON l.k = p.k
    WHERE l.k IS NULL OR p.k IS NULL""",
)
def dangling_labels(spark: SparkSession, root: str) -> DataFrame:
    """Parts at the last digit of a supplier against parts at the last digit of their size."""

    def at_digit(part: str, number: str) -> F.Column:
        return F.concat(_named("part", part), F.lit("-"), F.col(number) % 10).alias("label")

    return G.dangling_labels(
        table(spark, root, "lineitem").select(at_digit("l_partkey", "l_suppkey")),
        table(spark, root, "part").select(at_digit("p_partkey", "p_size")),
    )


@audit(
    "links_conflicts",
    """WITH claims AS (SELECT DISTINCT p_type AS rig, p_brand || ' ' || p_name AS links, p_name AS package, p_size AS version FROM part),
    contested AS (SELECT rig, links, count(*) AS n_claimants FROM claims GROUP BY ALL HAVING count(*) > 1)
    SELECT * FROM claims JOIN contested USING (rig, links)""",
)
def links_conflicts(spark: SparkSession, root: str) -> DataFrame:
    return G.links_conflicts(
        table(spark, root, "part").select(
            F.col("p_type").alias("rig"),
            F.concat_ws(" ", "p_brand", "p_name").alias("links"),
            F.col("p_name").alias("package"),
            F.col("p_size").alias("version"),
        )
    )


# Pruning: a customer needs the one with half its key, and is available with a
# positive balance. Nations are slots when a customer only counts within its own.
PRUNE_SQL = """needs AS (SELECT c_custkey AS crate, c_custkey // 2 AS need FROM customer WHERE c_custkey > 0),
  dropped(crate, round) AS (
    SELECT c_custkey, 1 FROM customer WHERE c_acctbal <= 0
    UNION SELECT needs.crate, round + 1 FROM dropped JOIN needs ON need = dropped.crate),
  pruned AS (SELECT crate, min(round) AS round FROM dropped GROUP BY crate)"""


def _pruned(spark: SparkSession, root: str) -> DataFrame:
    customers = table(spark, root, "customer")
    slot = F.lit("all").alias("slot")
    members = customers.select(slot, F.col("c_custkey").alias("crate"), (F.col("c_acctbal") > 0).alias("available"))
    needs = customers.where("c_custkey > 0").select(
        slot, F.col("c_custkey").alias("crate"), F.expr("c_custkey div 2").alias("needs")
    )
    return M.prune_to_consistent(members, needs)


@audit("prune_to_consistent", f"WITH RECURSIVE {PRUNE_SQL} SELECT crate, round FROM pruned")
def prune_to_consistent(spark: SparkSession, root: str) -> DataFrame:
    return _pruned(spark, root).select("crate", "round")


@audit(
    "pruned_list",
    f"""WITH RECURSIVE {PRUNE_SQL} SELECT 'all' AS slot, round, CAST(crate AS VARCHAR) AS crate FROM pruned""",
)
def pruned_list(spark: SparkSession, root: str) -> DataFrame:
    return M.pruned_list(_pruned(spark, root).withColumn("crate", F.col("crate").cast("string")))


# Suppliers are slots with the parts they deliver as members: a part is unavailable
# when large quantities of it were returned, needs the part with half its key where
# the supplier has it, asks that one for a feature that large parts lack, and rivals
# the parts of its brand and type.
SLOT_SQL = """members AS (
    SELECT l_suppkey AS slot, l_partkey AS crate, bool_and(l_returnflag <> 'R' OR l_quantity < 45) AS available,
      min(l_linenumber) AS line_no
    FROM lineitem GROUP BY ALL),
  needs AS (
    SELECT m.slot, m.crate, n.crate AS need FROM members m JOIN members n ON n.slot = m.slot AND n.crate = m.crate // 2
    WHERE m.crate > 0),
  missing AS (
    SELECT needs.slot, needs.need AS crate FROM needs JOIN part ON p_partkey = needs.need WHERE p_size > 48),
  first(slot, crate, round) AS (
    SELECT slot, crate, 1 FROM (SELECT slot, crate FROM members WHERE NOT available UNION SELECT slot, crate FROM missing)
    UNION SELECT needs.slot, needs.crate, round + 1 FROM first JOIN needs ON needs.slot = first.slot AND need = first.crate),
  gone AS (SELECT slot, crate, min(round) AS round FROM first GROUP BY slot, crate),
  rested AS (SELECT slot, max(round) AS before FROM gone GROUP BY slot),
  picked AS (
    SELECT m.slot, arg_min(m.crate, (m.line_no, m.crate)) AS crate
    FROM members m JOIN part ON p_partkey = m.crate LEFT JOIN gone ON gone.slot = m.slot AND gone.crate = m.crate
    WHERE p_brand = 'Brand#5' GROUP BY m.slot, p_type HAVING count(*) > 1 AND count(gone.crate) = 0),
  second(slot, crate, round) AS (
    SELECT picked.slot, crate, coalesce(before, 0) + 1 FROM picked LEFT JOIN rested ON rested.slot = picked.slot
    UNION SELECT needs.slot, needs.crate, second.round + 1 FROM second JOIN needs ON needs.slot = second.slot AND need = second.crate
    WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.slot = needs.slot AND gone.crate = needs.crate)),
  dropped AS (SELECT * FROM gone UNION ALL SELECT slot, crate, min(round) FROM second GROUP BY slot, crate)"""


@audit(
    "prune_slots",
    f"WITH RECURSIVE {SLOT_SQL} SELECT slot, crate, CAST(round AS INTEGER) AS round FROM dropped",
)
def prune_slots(spark: SparkSession, root: str) -> DataFrame:
    """All suppliers at once, with missing features and conflicts."""
    parts = table(spark, root, "part").select(F.col("p_partkey").alias("crate"), "p_size", "p_brand", "p_type")
    members = (
        table(spark, root, "lineitem")
        .groupBy(F.col("l_suppkey").alias("slot"), F.col("l_partkey").alias("crate"))
        .agg(
            F.bool_and(F.expr("l_returnflag <> 'R' OR l_quantity < 45")).alias("available"),
            F.min("l_linenumber").alias("line_no"),
        )
    )
    half = members.where("crate > 0").select("slot", "crate", F.expr("crate div 2").alias("needs"), F.lit("big").alias("feature"))
    needs = half.join(members.select("slot", F.col("crate").alias("needs")), ["slot", "needs"], "left_semi")
    offered = members.join(parts, "crate").where("p_size <= 48").select("slot", "crate", F.lit("big").alias("feature"))
    rivals = members.join(parts, "crate").where("p_brand = 'Brand#5'").select(
        "slot", F.col("p_type").alias("conflict_id"), "line_no", "crate"
    )
    # One part alone has no rival.
    alone = rivals.groupBy("slot", "conflict_id").count().where("count = 1").drop("count")
    conflicts = rivals.join(alone, ["slot", "conflict_id"], "left_anti")
    return M.prune_to_consistent(members, needs, conflicts, offered)


# Versions: a customer has up to three, by its balance, and some of them need one of the customer with half its key, in a range.
VERSIONS_SQL = """candidates AS (
    SELECT c_custkey AS crate, n AS v FROM customer, (VALUES (0), (1), (2)) AS t(n) WHERE c_acctbal > n * 1500 - 500),
  reqs AS (
    SELECT c_custkey AS crate, CASE WHEN c_custkey % 5 = 0 THEN 2 END AS v, c_custkey // 2 AS needs,
      CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS lo, CASE c_custkey % 3 WHEN 0 THEN 1 ELSE 2 END AS hi
    FROM customer WHERE c_custkey > 0),
  alive(iter, crate, v) AS (
    SELECT 0, crate, v FROM candidates
    UNION ALL
    SELECT iter + 1, a.crate, a.v FROM alive a ANTI JOIN (
      SELECT r.crate, r.v FROM reqs r LEFT JOIN alive b ON b.crate = r.needs AND b.v BETWEEN r.lo AND r.hi
      GROUP BY r.crate, r.v, r.needs, r.lo, r.hi HAVING count(b.crate) = 0) f ON f.crate = a.crate AND (f.v IS NULL OR f.v = a.v)
    WHERE iter < 24),
  fallen AS (SELECT crate, v, max(iter) + 1 AS round FROM alive GROUP BY crate, v HAVING max(iter) < 24)"""


def _versions(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    customers = table(spark, root, "customer")
    version = lambda n: F.concat(F.lit("1."), n, F.lit(".0"))
    each = customers.select("c_custkey", "c_acctbal", F.explode(F.array(*map(F.lit, range(3)))).alias("n")).where("c_acctbal > n * 1500 - 500")
    slot = F.lit("all").alias("slot")
    crate = F.col("c_custkey").alias("crate")
    text = F.when(F.col("c_custkey") % 3 == 0, "<1.2").when(F.col("c_custkey") % 3 == 1, "^1.1").otherwise("~1.2, *")
    of = F.when(F.col("c_custkey") % 5 == 0, version(F.lit(2)))
    asked = customers.where("c_custkey > 0").select(slot, crate, of.alias("version"), F.expr("c_custkey div 2").alias("needs"), text.alias("version_req"))
    return each.select(slot, crate, version(F.col("n")).alias("version")), asked


@audit(
    "prune_versions",
    f"""WITH RECURSIVE {VERSIONS_SQL} SELECT crate, '1.' || v || '.0' AS version, CAST(round AS INTEGER) AS round FROM fallen""",
)
def prune_versions(spark: SparkSession, root: str) -> DataFrame:
    return M.prune_versions(*_versions(spark, root)).select("crate", "version", "round")


@audit(
    "lost_crates",
    f"""WITH RECURSIVE {VERSIONS_SQL} SELECT crate, CAST(max(round) AS INTEGER) AS round FROM candidates LEFT JOIN fallen USING (crate, v)
    GROUP BY crate HAVING count(*) = count(round)""",
)
def lost_crates(spark: SparkSession, root: str) -> DataFrame:
    candidates, asked = _versions(spark, root)
    return M.lost_crates(candidates, M.prune_versions(candidates, asked)).select("crate", "round")


# Blame: a customer is a slot, its cheap orders give the manifest, its dear ones the
# lines of the resolver's log.
BLAME_SQL = """manifest AS (
    SELECT DISTINCT o_custkey AS slot, 'c' || left(o_orderpriority, 1) AS crate FROM orders WHERE o_totalprice < 150000),
  log AS (
    SELECT o_custkey AS slot, CAST(year(o_orderdate) AS INTEGER) AS round, o_orderkey AS line_no,
      CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'c' || left(o_orderpriority, 1) END AS crate
    FROM orders WHERE o_totalprice >= 150000),
  blamed AS (SELECT slot, round, arg_min(crate, line_no) FILTER (crate IS NOT NULL) AS crate FROM log GROUP BY slot, round)"""


def _blame(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders = table(spark, root, "orders")
    crate = F.concat(F.lit("c"), F.substring("o_orderpriority", 1, 1))
    manifest = orders.where("o_totalprice < 150000").select(F.col("o_custkey").alias("slot"), crate.alias("crate")).distinct()
    quoted = F.concat(F.lit("`"), crate, F.lit("`"))
    message = (
        F.when(F.col("o_orderstatus") == "F", "error: something else")
        .when(F.col("o_orderpriority").startswith("1"), F.concat(F.lit("error: no matching package named "), quoted, F.lit(" found")))
        .when(
            F.col("o_orderpriority").startswith("2"),
            F.concat(F.lit("package `x` depends on "), quoted, F.lit(" with feature `y` but it has none")),
        )
        .when(
            F.col("o_orderpriority").startswith("3"),
            F.concat(F.lit("failed to select a version for the requirement `"), crate, F.lit(' = "*"`')),
        )
        .otherwise(F.concat(F.lit("error: failed to select a version for "), quoted, F.lit(".")))
    )
    log = orders.where("o_totalprice >= 150000").select(
        F.col("o_custkey").alias("slot"), F.year("o_orderdate").alias("round"), F.col("o_orderkey").alias("line_no"), message.alias("line")
    )
    return M.apply_blame(manifest, log)


@audit(
    "blame_kept",
    f"""WITH {BLAME_SQL} SELECT slot, crate FROM manifest m
    WHERE NOT EXISTS (SELECT 1 FROM blamed b WHERE b.slot = m.slot AND b.crate = m.crate)""",
)
def blame_kept(spark: SparkSession, root: str) -> DataFrame:
    return _blame(spark, root)[0]


@audit("blame_dropped", f"WITH {BLAME_SQL} SELECT slot, round, crate FROM blamed JOIN manifest USING (slot, crate)")
def blame_dropped(spark: SparkSession, root: str) -> DataFrame:
    return _blame(spark, root)[1]


@audit(
    "blame_errors",
    f"""WITH {BLAME_SQL} SELECT slot, round, crate, CASE WHEN crate IS NULL THEN 'unhandled' ELSE 'transitive' END AS error
    FROM blamed b WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE b.slot = m.slot AND b.crate = m.crate)""",
)
def blame_errors(spark: SparkSession, root: str) -> DataFrame:
    return _blame(spark, root)[2]
