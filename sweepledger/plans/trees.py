"""Readers of manifests, locks, logs, directives and target files over trees written from the given tables.

Folders are nations and thousands of customers, so files stay small and their number grows with the table; the customers
are the lines of the one file in each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sinks.files import write_line_files
from ..sources import manifests as SM
from ..sources import sweeps as SS
from ..sources import targets as ST
from .inputs import table
from .registry import audit

FOLDER_SQL = "'n=' || c_nationkey || '-' || (c_custkey // 1000)"


# Customers of a task; a task writes their files one after the other.
TASK_ROWS = 16_000


def tree(spark: SparkSession, root: str, name: str, line: Column, head: str | None = None, below: str = "") -> str:
    """A folder per nation and thousand customers with one file ``name``: ``head``, then a text per customer, in order.

    Returns the root. The number of tasks follows the number of customers: their rows are so small that adaptive execution would
    put thousands of files into one task.
    """
    out = scratch_path(spark, "tree")
    folder = F.concat_ws("-", "c_nationkey", F.expr("c_custkey div 1000"))
    named = F.concat(F.lit("n="), F.coalesce(F.nullif(folder, F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__")), F.lit(f"/{name}"))
    customers = table(spark, root, "customer")
    rows = customers.select(named.alias("path"), F.col("c_custkey").alias("at"), line.alias("line"))
    if head is not None:
        rows = rows.unionByName(rows.select("path").distinct().select("path", F.lit(-1).alias("at"), F.lit(head).alias("line")))
    tasks = -(-customers.count() // TASK_ROWS) or 1
    write_line_files(rows.repartition(tasks, "path").sortWithinPartitions("path", "at"), f"{out}/{below}" if below else out)
    return out


def key() -> Column:
    return F.col("c_custkey").cast("string")


@audit(
    "manifest_tree",
    f"""SELECT {FOLDER_SQL} AS rig, 'c' || c_custkey AS crate, '1.' || c_custkey AS version_req FROM customer""",
)
def manifest_tree(spark: SparkSession, root: str) -> DataFrame:
    line = F.concat(F.lit("c"), key(), F.lit(' = "1.'), key(), F.lit('"'))
    return SM.read_manifest_deps(spark, tree(spark, root, "Cargo.toml", line, "[dependencies]")).select("rig", "crate", "version_req")


@audit(
    "lock_tree",
    f"""SELECT {FOLDER_SQL} AS rig, 'c' || c_custkey AS crate, c_custkey || '.0.1' AS version FROM customer""",
)
def lock_tree(spark: SparkSession, root: str) -> DataFrame:
    line = F.concat(F.lit('[[package]]\nname = "c'), key(), F.lit('"\nversion = "'), key(), F.lit('.0.1"\n'))
    return SM.read_lock_packages(spark, tree(spark, root, "Cargo.lock", line, "version = 4"))


@audit(
    "resolver_log_tree",
    f"""SELECT {FOLDER_SQL} AS slot, 7 AS round,
      CAST(row_number() OVER (PARTITION BY c_nationkey, c_custkey // 1000 ORDER BY c_custkey) AS INTEGER) AS line_no,
      'error: ' || c_custkey AS line
    FROM customer""",
)
def resolver_log_tree(spark: SparkSession, root: str) -> DataFrame:
    return SS.read_resolver_logs(spark, tree(spark, root, "7.log", F.concat(F.lit("error: "), key()))).where("line <> ''")


@audit(
    "collection_tree",
    f"""SELECT {FOLDER_SQL} AS crate, 'list.txt' AS path,
      sha256(string_agg('c' || c_custkey, chr(10) ORDER BY c_custkey) || chr(10)) AS content_hash
    FROM customer GROUP BY c_nationkey, c_custkey // 1000""",
)
def collection_tree(spark: SparkSession, root: str) -> DataFrame:
    found = SS.read_collection(spark, tree(spark, root, "list.txt", F.concat(F.lit("c"), key())))
    return found.select("crate", "path", "content_hash")


DIRECTIVE_TREE_SQL = f"""SELECT '' AS rig_scope, {FOLDER_SQL} AS crate, 0 AS section_no, 'k' || c_custkey AS key,
      'int' AS value_kind, CAST(c_custkey AS VARCHAR) AS value_json
    FROM customer"""


@audit("directive_tree", DIRECTIVE_TREE_SQL)
def directive_tree(spark: SparkSession, root: str) -> DataFrame:
    """Below a folder of directives, read from its parent."""
    line = F.concat(F.lit("k"), key(), F.lit(" = "), key())
    return SM.read_fixup_directives(spark, tree(spark, root, "fixups.toml", line, below="fixups")).drop("gate")


@audit("directive_folder", DIRECTIVE_TREE_SQL)
def directive_folder(spark: SparkSession, root: str) -> DataFrame:
    """The same read from the folder of directives itself."""
    line = F.concat(F.lit("k"), key(), F.lit(" = "), key())
    return SM.read_fixup_directives(spark, tree(spark, root, "fixups.toml", line, below="fixups") + "/fixups").drop("gate")


@audit(
    "target_tree",
    f"""SELECT {FOLDER_SQL} AS rig, 'fixups//' || {FOLDER_SQL} || ':c-' || c_custkey AS src,
      'fixups//' || {FOLDER_SQL} || ':c-' || (c_custkey // 2) AS dst
    FROM customer""",
)
def target_tree(spark: SparkSession, root: str) -> DataFrame:
    half = F.expr("c_custkey div 2").cast("string")
    line = F.concat(F.lit('cargo.rust_library(name = "c-'), key(), F.lit('", crate = "c", deps = [":c-'), half, F.lit('"])'))
    targets = ST.read_target_graph(spark, tree(spark, root, "BUCK", line))
    edges = ST.target_edges(targets).select("src", "dst")
    return edges.select(F.regexp_extract("src", "//([^:]*):", 1).alias("rig"), "src", "dst")
