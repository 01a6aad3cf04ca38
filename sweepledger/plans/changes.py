"""Change impact: changed paths to the targets to build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..fixed_values import RIG_FIXUP_PATH, RIG_OF_FIXUP_PATH, SHARED_FIXUP_PATH
from ..operators import impact as I
from ..sources.manifests import rig_inventory
from .inputs import LABEL_SQL, RIG_LABEL_SQL, crate_name, label, rig_label, table, versioned_name
from .registry import audit

VERSIONED_SQL = "(replace(p_name, ' ', '_') || '-' || p_size)"

# Paths of a change: large parts of one brand change in their rig, cheap ones of
# another change for all rigs, some have no target, the rest are other files.
PATHS_SQL = """paths AS (
  SELECT CASE
    WHEN p_brand = 'Brand#7' AND p_type IN ('PROMO', 'SMALL') AND p_size > 30
      THEN 'third-party/conflict-rigs/' || lower(p_type) || '/fixups/' || replace(p_name, ' ', '_') || '/fixups.toml'
    WHEN p_brand = 'Brand#9' AND p_size > 45 THEN 'fixups/' || replace(p_name, ' ', '_') || '-' || p_size || '/fixups.toml'
    WHEN p_brand = 'Brand#11' AND p_size > 40
      THEN 'fixups/' || replace(p_name, ' ', '_') || '_derive/' || p_size || '.patch'
    WHEN p_brand = 'Brand#3' THEN 'fixups/' || replace(p_name, ' ', '_') || '.md'
    ELSE 'docs/' || p_partkey || '.md' END AS path
  FROM part)"""
CRATES_SQL = f"""crates AS (
  SELECT DISTINCT crate FROM (
    SELECT coalesce(
      nullif(regexp_extract(path, '{SHARED_FIXUP_PATH}', 1), ''),
      nullif(regexp_extract(path, '{RIG_FIXUP_PATH}', 1), '')) AS crate
    FROM paths)
  WHERE crate IS NOT NULL)"""
RIGS_SQL = f"""rigs AS (
  SELECT DISTINCT regexp_extract(path, '{RIG_OF_FIXUP_PATH}', 1) AS rig
  FROM paths WHERE regexp_matches(path, '{RIG_OF_FIXUP_PATH}'))"""
TARGETS_SQL = f"targets AS (SELECT DISTINCT {RIG_LABEL_SQL} AS label FROM part)"
# Known-broken targets: parts of which over a third of the lines came back.
BROKEN_SQL = f"""broken AS (
  SELECT DISTINCT {RIG_LABEL_SQL} AS label FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY l_partkey, label HAVING 3 * count(*) FILTER (l_returnflag = 'R') > count(*))"""
STEM_SQL = "regexp_replace({}, '-[0-9][0-9.]*$', '')"
HITS_SQL = f"""hits AS (
  SELECT label FROM targets WHERE EXISTS (
    SELECT 1 FROM crates WHERE crate = split_part(label, ':', 2) OR crate = {STEM_SQL.format("split_part(label, ':', 2)")})
  UNION
  SELECT label FROM targets JOIN rigs ON split_part(label, ':', 1) = 'fixups//' || rig)"""


def paths(spark: SparkSession, root: str) -> DataFrame:
    brand, size = F.col("p_brand"), F.col("p_size")
    in_rig = (brand == "Brand#7") & F.col("p_type").isin("PROMO", "SMALL") & (size > 30)
    path = (
        F.when(
            in_rig,
            F.concat(
                F.lit("third-party/conflict-rigs/"), F.lower("p_type"), F.lit("/fixups/"), crate_name(), F.lit("/fixups.toml")
            ),
        )
        .when((brand == "Brand#9") & (size > 45), F.concat(F.lit("fixups/"), versioned_name(), F.lit("/fixups.toml")))
        .when(
            (brand == "Brand#11") & (size > 40),
            F.concat(F.lit("fixups/"), crate_name(), F.lit("_derive/"), size, F.lit(".patch")),
        )
        .when(brand == "Brand#3", F.concat(F.lit("fixups/"), crate_name(), F.lit(".md")))
        .otherwise(F.concat(F.lit("docs/"), "p_partkey", F.lit(".md")))
    )
    return table(spark, root, "part").select(path.alias("path"))


def _targets(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select(rig_label().alias("label"))


def _broken(spark: SparkSession, root: str) -> DataFrame:
    """Parts of which over a third of the lines came back."""
    returned = F.count_if(F.col("l_returnflag") == "R") * 3 > F.count("*")
    seen = table(spark, root, "lineitem").groupBy("l_partkey").agg(returned.alias("broken")).where("broken")
    return seen.join(table(spark, root, "part"), F.col("l_partkey") == F.col("p_partkey")).select(rig_label().alias("label"))


@audit("changed_crates", f"WITH {PATHS_SQL}, {CRATES_SQL} SELECT crate FROM crates")
def changed_crates(spark: SparkSession, root: str) -> DataFrame:
    return I.changed_crates(paths(spark, root))


@audit("changed_rigs", f"WITH {PATHS_SQL}, {RIGS_SQL} SELECT rig FROM rigs")
def changed_rigs(spark: SparkSession, root: str) -> DataFrame:
    return I.changed_rigs(paths(spark, root))


@audit(
    "impacted_targets",
    f"""WITH {PATHS_SQL}, {CRATES_SQL}, {TARGETS_SQL}
    SELECT DISTINCT label FROM targets, crates
    WHERE regexp_matches(label, ':' || crate || '(-[0-9][0-9.]*)?$')""",
)
def impacted_targets(spark: SparkSession, root: str) -> DataFrame:
    """The SQL is the regular-expression join; ours is an equi-join."""
    return I.impacted_targets(I.changed_crates(paths(spark, root)), _targets(spark, root))


@audit(
    "impacted_rigs",
    f"""WITH {PATHS_SQL}, {RIGS_SQL}, {TARGETS_SQL}
    SELECT label FROM targets WHERE split_part(label, ':', 1) IN (SELECT 'fixups//' || rig FROM rigs)""",
)
def impacted_rigs(spark: SparkSession, root: str) -> DataFrame:
    return I.impacted_rigs(I.changed_rigs(paths(spark, root)), _targets(spark, root))


@audit(
    "drop_known_broken",
    f"""WITH {TARGETS_SQL}, {BROKEN_SQL}
    SELECT label FROM targets WHERE NOT EXISTS (
      SELECT 1 FROM broken WHERE {STEM_SQL.format('broken.label')} = {STEM_SQL.format('targets.label')})""",
)
def drop_known_broken(spark: SparkSession, root: str) -> DataFrame:
    return I.drop_known_broken(_targets(spark, root).distinct(), _broken(spark, root))


@audit(
    "unmatched_changes",
    f"""WITH {PATHS_SQL}, {CRATES_SQL}, {TARGETS_SQL}
    SELECT crate FROM crates WHERE NOT EXISTS (
      SELECT 1 FROM targets
      WHERE split_part(label, ':', 2) = crate OR {STEM_SQL.format("split_part(label, ':', 2)")} = crate)""",
)
def unmatched_changes(spark: SparkSession, root: str) -> DataFrame:
    return I.unmatched_changes(I.changed_crates(paths(spark, root)), _targets(spark, root))


@audit(
    "change_impact",
    f"""WITH {PATHS_SQL}, {CRATES_SQL}, {RIGS_SQL}, {TARGETS_SQL}, {BROKEN_SQL}, {HITS_SQL}
    SELECT label FROM hits WHERE {STEM_SQL.format('label')} NOT IN (SELECT {STEM_SQL.format('label')} FROM broken)""",
)
def change_impact(spark: SparkSession, root: str) -> DataFrame:
    return I.change_impact(paths(spark, root), _targets(spark, root), _broken(spark, root))


@audit(
    "label_parts",
    f"""SELECT p_partkey, split_part({LABEL_SQL}, ':', 1) AS package,
      replace(p_name, ' ', '_') || '-' || p_size AS name, replace(p_name, ' ', '_') AS stem,
      CAST(p_size AS VARCHAR) AS version,
      CASE WHEN {VERSIONED_SQL} IN ('small_ring-11', 'red_widget-28') THEN {VERSIONED_SQL}
        ELSE replace(p_name, ' ', '_') END AS protected_stem
    FROM part""",
)
def label_parts(spark: SparkSession, root: str) -> DataFrame:
    parts = table(spark, root, "part").select("p_partkey", label().alias("label"))
    name = L.name_of(F.col("label"))
    return parts.select(
        "p_partkey",
        L.package_of(F.col("label")).alias("package"),
        name.alias("name"),
        L.stem(name).alias("stem"),
        L.version_of(name).alias("version"),
        L.stem(name, ["small_ring-11", "red_widget-28"]).alias("protected_stem"),
    )


@audit(
    "kind_filter",
    f"""SELECT {LABEL_SQL} AS label, CASE WHEN p_size > 25 THEN 'cargo.' ELSE '' END || lower(p_type) AS kind
    FROM part WHERE p_type IN ('PROMO', 'SMALL')""",
)
def kind_filter(spark: SparkSession, root: str) -> DataFrame:
    prefix = F.when(F.col("p_size") > 25, "cargo.").otherwise("")
    targets = table(spark, root, "part").select(
        label().alias("label"), F.concat(prefix, F.lower("p_type")).alias("kind")
    )
    return I.of_kind(targets, ["promo", "small"])


@audit(
    "rig_inventory",
    """SELECT 'third-party' AS rig, 'main' AS rig_kind, NULL AS slot
    UNION SELECT 'third-party/snapshots/' || year(o_orderdate) || '-' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0'),
      'snapshot', year(o_orderdate) || '-' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0')
    FROM orders WHERE o_orderstatus = 'F'
    UNION SELECT 'third-party/conflict-rigs/' || o_custkey, 'conflict', NULL FROM orders WHERE o_orderstatus = 'O'""",
)
def rigs(spark: SparkSession, root: str) -> DataFrame:
    month = F.concat_ws("-", F.year("o_orderdate"), F.lpad(F.month("o_orderdate").cast("string"), 2, "0"))
    status = F.col("o_orderstatus")
    path = (
        F.when(status == "F", F.concat(F.lit("third-party/snapshots/"), month, F.lit("/Cargo.toml")))
        .when(status == "O", F.concat(F.lit("third-party/conflict-rigs/"), "o_custkey", F.lit("/Cargo.toml")))
        .otherwise(F.concat(F.lit("third-party/snapshots/"), month, F.lit("/fixups/Cargo.toml")))
    )
    return rig_inventory(table(spark, root, "orders").select(path.alias("path")))
