"""Manifests, slots and version gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.versions import is_prerelease, version_key
from ..operators import gates as V
from ..operators import manifests as M
from ..session import stage
from ..sources import manifests as SM
from ..sources.targets import parse_targets, target_edges
from .inputs import balanced, crate_name, table, year_of
from .registry import audit

CRATE_SQL = "replace(p_name, ' ', '_')"
# The slots that have a column of their own; rows of all others are marked as such.
YEARS = tuple(str(year) for year in range(1995, 2001))

# Manifests -----------------------------------------------------------------------

# Small parts have features, promoted ones switch the default features off.
DEPS_SQL = f"""deps AS (
    SELECT p_type AS slot, {CRATE_SQL} || '_' || p_partkey AS crate, p_brand, lower(p_type) AS feature,
      p_size < 10 AS has_features, p_type = 'PROMO' AS no_default
    FROM part WHERE p_name NOT IN ('small ring', 'red widget'))"""


def manifest_deps_of(spark: SparkSession, root: str) -> DataFrame:
    small = F.col("p_size") < 10
    return table(spark, root, "part").select(
        F.col("p_type").alias("slot"),
        F.when(F.col("p_name").isin("small ring", "red widget"), crate_name())
        .otherwise(F.concat(crate_name(), F.lit("_"), "p_partkey"))
        .alias("crate"),
        F.concat(F.lit("^1."), "p_size").alias("version_req"),
        F.when(small, F.array("p_brand", F.lower("p_type"))).otherwise(F.array().cast("array<string>")).alias("features"),
        F.when(F.col("p_type") == "PROMO", F.lit(False)).when(F.col("p_type") == "SMALL", F.lit(True)).alias("default_features"),
        F.lit("renamed").alias("package"),
    )


SKIPPED = ("small_ring", "red_widget")


@audit(
    "float_deps",
    f"""WITH {DEPS_SQL} SELECT slot, crate, '*' AS version_req,
      CASE WHEN has_features THEN p_brand || ',' || feature END AS features,
      CASE WHEN no_default THEN 'false' END AS default_features
    FROM deps""",
)
def float_deps(spark: SparkSession, root: str) -> DataFrame:
    floated = M.float_deps(manifest_deps_of(spark, root), SKIPPED).withColumn("features", F.array_join("features", ","))
    return floated.withColumn("default_features", F.col("default_features").cast("string"))


@audit(
    "manifest_lines",
    f"""WITH {DEPS_SQL} SELECT slot, crate, crate || ' = ' || CASE
      WHEN has_features AND no_default
        THEN '{{ version = "*", default-features = false, features = ["' || p_brand || '", "' || feature || '"] }}'
      WHEN has_features THEN '{{ version = "*", features = ["' || p_brand || '", "' || feature || '"] }}'
      WHEN no_default THEN '{{ version = "*", default-features = false }}'
      ELSE '"*"' END AS line
    FROM deps""",
)
def manifest_lines(spark: SparkSession, root: str) -> DataFrame:
    return M.manifest_lines(M.float_deps(manifest_deps_of(spark, root), SKIPPED))


@audit(
    "manifest_deps",
    f"""SELECT p_partkey, {CRATE_SQL} AS crate, '^1.' || p_size AS version_req, NULL AS features,
      NULL AS default_features, NULL AS package FROM part
    UNION ALL SELECT p_partkey, 'dep-' || p_partkey, '=' || p_size,
      CASE WHEN p_size < 25 THEN p_brand || ',' || p_type END, CAST(p_size > 20 AS VARCHAR), p_brand
    FROM part""",
)
def manifest_deps(spark: SparkSession, root: str) -> DataFrame:
    """Every part as a manifest of its own, with a plain and a table requirement."""
    features = F.when(
        F.col("p_size") < 25, F.format_string(', features = ["%s", "%s"]', "p_brand", "p_type")
    ).otherwise("")
    content = F.concat(
        F.format_string('[package]\nname = "p"\n\n[dependencies]\n%s = "^1.%d" # plain\n', crate_name(), "p_size"),
        F.format_string('dep-%d = { version = "=%d"', "p_partkey", "p_size"),
        features,
        F.format_string(", default-features = %s", (F.col("p_size") > 20).cast("string")),
        F.format_string(', package = "%s" }\n[target."cfg(unix)".dependencies]\nunread = "1"\n', "p_brand"),
    )
    parts = balanced(table(spark, root, "part").select("p_partkey", "p_name", "p_size", "p_brand", "p_type"), "p_partkey")
    texts = parts.select(F.col("p_partkey").cast("string").alias("source"), content.alias("content"))
    deps = SM.parse_manifest_deps(texts).withColumn("features", F.array_join("features", ","))
    deps = deps.withColumn("default_features", F.col("default_features").cast("string"))
    return deps.withColumn("source", F.col("source").cast("bigint")).withColumnRenamed("source", "p_partkey")


@audit(
    "package_count",
    """SELECT p_type AS rig, count(*) + count(*) FILTER (p_size > 25) AS package_count FROM part GROUP BY 1""",
)
def package_count(spark: SparkSession, root: str) -> DataFrame:
    """Every part as a lock of one or two packages."""
    one = F.format_string('version = 4\n[[package]]\nname = "%s"\nversion = "%d.0.0"\n', crate_name(), "p_size")
    two = F.when(F.col("p_size") > 25, '[[package]]\nname = "extra"\nversion = "1.2.3"\ndependencies = ["a"]\n').otherwise("")
    parts = balanced(table(spark, root, "part").select("p_partkey", "p_name", "p_size", "p_type"), "p_partkey")
    texts = parts.select(F.col("p_type").alias("source"), F.concat(one, two).alias("content"))
    return M.package_count(SM.parse_lock_packages(texts).withColumnRenamed("source", "rig"))


@audit(
    "slot_matrix",
    f"""WITH deps AS (
      SELECT CASE WHEN o_orderstatus = 'O' THEN 'main' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS rig, o_custkey AS crate
      FROM orders)
    SELECT crate, {", ".join(f"bool_or(rig = '{y}') AS in_{y}" for y in YEARS)},
      bool_or(rig NOT IN ('main', {", ".join(f"'{y}'" for y in YEARS)})) AS in_other,
      min(rig) FILTER (rig IN ({", ".join(f"'{y}'" for y in YEARS)})) AS first_slot,
      count(DISTINCT rig) FILTER (rig IN ({", ".join(f"'{y}'" for y in YEARS)})) AS n_slots,
      NOT bool_or(rig = 'main') AS absent_vs_main
    FROM deps GROUP BY crate""",
)
def slot_matrix(spark: SparkSession, root: str) -> DataFrame:
    rig = F.when(F.col("o_orderstatus") == "O", "main").otherwise(year_of("o_orderdate"))
    return M.slot_matrix(table(spark, root, "orders").select(rig.alias("rig"), F.col("o_custkey").alias("crate")), YEARS)


@audit(
    "platform_matrix",
    """SELECT 'part-' || l_partkey || '-' || l_suppkey AS label, bool_or(l_returnflag = 'A') AS on_A, bool_or(l_returnflag = 'N') AS on_N,
      bool_or(l_returnflag NOT IN ('A', 'N')) AS on_other, count(DISTINCT l_returnflag) FILTER (l_returnflag IN ('A', 'N')) AS n_platforms,
      count(DISTINCT l_returnflag) FILTER (l_returnflag IN ('A', 'N')) = 2 AS everywhere
    FROM lineitem GROUP BY 1""",
)
def platform_matrix(spark: SparkSession, root: str) -> DataFrame:
    known = table(spark, root, "lineitem").select(
        F.concat(F.lit("part-"), "l_partkey", F.lit("-"), "l_suppkey").alias("label"), F.col("l_returnflag").alias("platform")
    )
    return M.platform_matrix(known, ["A", "N"])  # returned lines are of a platform that is not listed


def _slots_of(rows: DataFrame) -> list[str]:
    """The years that occur, so that no row falls outside; as many as there are years."""
    return sorted(r["slot"] for r in rows.select("slot").distinct().collect())


@audit(
    "latest_by_year",
    """WITH years AS (SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS slot FROM orders),
    ranked AS (
      SELECT o_custkey, slot, o_orderkey, row_number() OVER (
        PARTITION BY o_custkey, slot ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
      FROM orders JOIN years ON CAST(year(o_orderdate) AS VARCHAR) <= slot)
    SELECT o_custkey, slot, o_orderkey FROM ranked WHERE r = 1""",
)
def latest_by_year(spark: SparkSession, root: str) -> DataFrame:
    """Each customer's latest order up to the end of each year."""
    orders = table(spark, root, "orders").select("o_custkey", "o_orderkey", "o_orderdate", year_of("o_orderdate").alias("slot"))
    order = F.struct("o_orderdate", "o_orderkey")
    return M.latest_by_slot(orders, None, ["o_custkey"], order).drop("o_orderdate")


@audit(
    "era_latest",
    f"""WITH index AS (
      SELECT DISTINCT {CRATE_SQL} || '-' || p_brand AS crate, p_size AS major, l_linenumber AS minor,
        CAST(year(l_shipdate) AS VARCHAR) AS slot
      FROM lineitem JOIN part ON l_partkey = p_partkey
      WHERE l_returnflag <> 'R' AND NOT (l_linestatus = 'F' AND l_linenumber > 5)),
    years AS (SELECT DISTINCT CAST(year(l_shipdate) AS VARCHAR) AS era FROM lineitem),
    ranked AS (
      SELECT crate, era, major, minor, row_number() OVER (PARTITION BY crate, era ORDER BY major DESC, minor DESC) AS r
      FROM index JOIN years ON slot <= era)
    SELECT crate, era AS slot, major || '.' || minor AS version FROM ranked WHERE r = 1""",
)
def era_latest(spark: SparkSession, root: str) -> DataFrame:
    """Part sizes and line numbers as versions; returned lines were yanked."""
    lines = table(spark, root, "lineitem").select(
        "l_partkey", "l_linenumber", "l_linestatus", (F.col("l_returnflag") == "R").alias("yanked"), year_of("l_shipdate").alias("slot")
    )
    pre = F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") > 5), "-rc.1").otherwise("")
    index = (
        lines.distinct()
        .join(table(spark, root, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat(crate_name(), F.lit("-"), "p_brand").alias("crate"),
            F.concat("p_size", F.lit("."), "l_linenumber", pre).alias("version"),
            "yanked",
            "slot",
        )
    )
    return M.era_latest(index, _slots_of(lines))


# Requirement texts of all forms from the parts' keys and sizes, and the half-open ranges they stand for.
RANGE_SQL = """numbers AS (SELECT p_partkey AS k, p_partkey % 9 AS form, p_size % 3 AS a, p_partkey % 4 AS b, p_size % 5 AS c FROM part),
  ranges AS (
    SELECT k, CASE form
        WHEN 0 THEN a || '.' || b || '.' || c WHEN 1 THEN '^' || a || '.' || b WHEN 2 THEN '~' || a || '.' || b || '.' || c
        WHEN 3 THEN '=' || a || '.' || b || '.' || c WHEN 4 THEN '>=' || a || '.' || b || ', <' || (a + 1)
        WHEN 5 THEN '>' || a || '.' || b WHEN 6 THEN '<=' || a || '.' || b || '.' || c WHEN 7 THEN a || '.*' ELSE '*' END AS req,
      CASE WHEN form IN (0, 2, 3) THEN a || '.' || b || '.' || c WHEN form IN (1, 4) THEN a || '.' || b || '.0'
        WHEN form = 5 THEN a || '.' || (b + 1) || '.0' WHEN form = 7 THEN a || '.0.0' END AS lo,
      CASE
        WHEN form = 0 THEN CASE WHEN a > 0 THEN (a + 1) || '.0.0' WHEN b > 0 THEN '0.' || (b + 1) || '.0' ELSE '0.0.' || (c + 1) END
        WHEN form = 1 THEN CASE WHEN a > 0 THEN (a + 1) || '.0.0' ELSE '0.' || (b + 1) || '.0' END
        WHEN form = 2 THEN a || '.' || (b + 1) || '.0'
        WHEN form IN (3, 6) THEN a || '.' || b || '.' || (c + 1)
        WHEN form IN (4, 7) THEN (a + 1) || '.0.0' END AS hi
    FROM numbers)"""


def _requirements(spark: SparkSession, root: str) -> DataFrame:
    a, b, c = F.col("p_size") % 3, F.col("p_partkey") % 4, F.col("p_size") % 5
    two, three = F.concat_ws(".", a, b), F.concat_ws(".", a, b, c)
    forms = [
        three, F.concat(F.lit("^"), two), F.concat(F.lit("~"), three), F.concat(F.lit("="), three),
        F.concat(F.lit(">="), two, F.lit(", <"), a + 1), F.concat(F.lit(">"), two), F.concat(F.lit("<="), three), F.concat(a, F.lit(".*")), F.lit("*"),
    ]
    text = F.element_at(F.array(*forms), (F.col("p_partkey") % 9 + 1).cast("int"))
    return table(spark, root, "part").select(F.col("p_partkey").alias("k"), F.concat(crate_name(), F.lit("-"), "p_brand").alias("crate"), text.alias("version_req"))


@audit("requirement_ranges", f"WITH {RANGE_SQL} SELECT k, req AS version_req, lo, hi, true AS read FROM ranges")
def requirement_ranges(spark: SparkSession, root: str) -> DataFrame:
    ranges = M.with_range(_requirements(spark, root)).drop("crate")
    return ranges.withColumns({side: F.array_join(F.col(side).cast("array<string>"), ".") for side in ("lo", "hi")})


@audit(
    "latest_in_range",
    f"""WITH {RANGE_SQL},
    published AS (
      SELECT {CRATE_SQL} || '-' || p_brand AS crate, l_linenumber % 4 AS a, CAST(l_suppkey % 5 AS BIGINT) AS b, min(CAST(year(l_shipdate) AS VARCHAR)) AS slot
      FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' GROUP BY ALL),
    years AS (SELECT DISTINCT CAST(year(l_shipdate) AS VARCHAR) AS era FROM lineitem),
    asked AS (
      SELECT DISTINCT {CRATE_SQL} || '-' || p_brand AS crate, req,
        list_transform(string_split(lo, '.'), lambda x: CAST(x AS BIGINT)) AS lo, list_transform(string_split(hi, '.'), lambda x: CAST(x AS BIGINT)) AS hi
      FROM ranges JOIN part ON p_partkey = k),
    ranked AS (
      SELECT era, crate, req, a, b, row_number() OVER (PARTITION BY era, crate, req ORDER BY a DESC, b DESC) AS r
      FROM asked JOIN published USING (crate) JOIN years ON slot <= era
      WHERE (lo IS NULL OR [a, b, 0] >= lo) AND (hi IS NULL OR [a, b, 0] < hi))
    SELECT era AS slot, crate, req AS version_req, a || '.' || b AS version FROM ranked WHERE r = 1""",
)
def latest_in_range(spark: SparkSession, root: str) -> DataFrame:
    """Line and supplier numbers as versions; returned lines were yanked."""
    lines = table(spark, root, "lineitem").select(
        "l_partkey", F.concat_ws(".", F.col("l_linenumber") % 4, F.col("l_suppkey") % 5).alias("version"),
        (F.col("l_returnflag") == "R").alias("yanked"), year_of("l_shipdate").alias("slot"),
    )
    parts = table(spark, root, "part").select("p_partkey", F.concat(crate_name(), F.lit("-"), "p_brand").alias("crate"))
    index = lines.distinct().join(parts, F.col("l_partkey") == F.col("p_partkey")).select("crate", "version", "yanked", "slot")
    return M.latest_in_range(index, _requirements(spark, root), _slots_of(lines))


# Gates ---------------------------------------------------------------------------

# The sizes of a brand's parts are its versions; per type, from the least to the
# mean size is a gate.
GATES_SQL = """gates AS (
    SELECT p_brand, p_type, min(p_size) AS lo, CAST(ceil(avg(p_size)) AS INTEGER) AS hi FROM part GROUP BY ALL)"""


def _resolved(spark: SparkSession, root: str) -> DataFrame:
    version = F.concat("p_size", F.lit(".0.0"))
    return V.with_version_key(
        table(spark, root, "part").select("p_partkey", F.col("p_brand").alias("crate"), version.alias("version"))
    )


def _gates(spark: SparkSession, root: str) -> DataFrame:
    bounds = table(spark, root, "part").groupBy(F.col("p_brand").alias("crate"), F.col("p_type").alias("name")).agg(
        F.min("p_size").alias("least"), F.ceil(F.avg("p_size")).alias("mean")
    )
    gate = F.format_string('cfg(version = ">=%d, <%d.0")', "least", "mean")
    return V.with_bounds(bounds.select("crate", "name", gate.alias("gate")))


@audit(
    "parse_version_gate",
    f"""WITH {GATES_SQL} SELECT p_brand AS crate, p_type AS name, 'cfg(version = ">=' || lo || ', <' || hi || '.0")' AS gate,
      lo || '.0.0' AS lo, hi || '.0.0' AS hi, false AS hi_inc, false AS exact, true AS version_only FROM gates""",
)
def parsed_gates(spark: SparkSession, root: str) -> DataFrame:
    gates = _gates(spark, root)
    for bound in ("lo", "hi"):
        gates = gates.withColumn(bound, F.array_join(F.col(bound).cast("array<string>"), "."))
    return gates


@audit(
    "gate_matches",
    f"""WITH {GATES_SQL} SELECT p_partkey, gates.p_type AS name
    FROM part JOIN gates USING (p_brand) WHERE p_size >= lo AND p_size < hi""",
)
def gate_matches(spark: SparkSession, root: str) -> DataFrame:
    return V.gate_matches(_resolved(spark, root), _gates(spark, root)).select("p_partkey", "name")


# Every part is a crate, the quantities of its lines are the versions in use. A part's gate is its
# size: exactly this version for odd parts, this and the four after it for even ones.
USED_SQL = """used AS (SELECT DISTINCT l_partkey AS part, CAST(l_quantity AS BIGINT) AS major FROM lineitem),
  sized AS (
    SELECT p_partkey AS part, p_size AS lo, CASE WHEN p_partkey % 2 = 1 THEN p_size ELSE p_size + 4 END AS last,
      CASE WHEN p_partkey % 2 = 1 THEN 'cfg(version = "=' || p_size || '")'
        ELSE 'cfg(version = ">=' || p_size || ', <' || (p_size + 5) || '")' END AS gate
    FROM part)"""


# Lines of a task that makes them distinct, parts of one that reads their gates; parts whose gates Spark may broadcast.
TASK_LINES, TASK_GATES, BROADCAST_GATES = 250_000, 25_000, 100_000


def _used(spark: SparkSession, root: str) -> DataFrame:
    """Each crate and version key once: a version with a minus before it has no key, like none.

    The number of tasks follows the number of lines: these are a few bytes each in a shuffle and many times that in a hash table, so
    adaptive execution would give millions to a task.
    """
    major = F.col("l_quantity").cast("bigint")
    items = table(spark, root, "lineitem").select("l_partkey", F.when(major >= 0, major).alias("major"))
    tasks = -(-items.count() // TASK_LINES) or 1
    lines = items.repartition(tasks, "l_partkey", "major").distinct()
    version = F.concat("major", F.lit(".0.0"))
    return V.with_version_key(lines.select(F.concat(F.lit("part-"), "l_partkey").alias("crate"), version.alias("version")))


def _sized(spark: SparkSession, root: str) -> DataFrame:
    exact = F.format_string('cfg(version = "=%d")', "p_size")
    wide = F.format_string('cfg(version = ">=%d, <%d")', "p_size", F.col("p_size") + 5)
    gate = F.when(F.col("p_partkey") % 2 == 1, exact).otherwise(wide)
    tasks = -(-table(spark, root, "part").count() // TASK_GATES) or 1
    parts = table(spark, root, "part").select("p_partkey", "p_size").repartition(tasks)
    return V.with_bounds(parts.select(F.concat(F.lit("part-"), "p_partkey").alias("crate"), gate.alias("gate")))


@audit(
    "dead_gates",
    f"""WITH {USED_SQL} SELECT 'part-' || part AS crate, gate FROM sized s
    WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.part = s.part AND u.major BETWEEN lo AND last)""",
)
def dead_gates(spark: SparkSession, root: str) -> DataFrame:
    return V.dead_gates(_sized(spark, root), _used(spark, root), once=True).select("crate", "gate")


@audit(
    "uncovered_versions",
    f"""WITH {USED_SQL} SELECT 'part-' || part AS crate, major FROM used u
    WHERE part IN (SELECT part FROM sized)
      AND NOT EXISTS (SELECT 1 FROM sized s WHERE u.part = s.part AND u.major BETWEEN lo AND last)""",
)
def uncovered_versions(spark: SparkSession, root: str) -> DataFrame:
    many = table(spark, root, "part").count() > BROADCAST_GATES
    found = V.uncovered_versions(_used(spark, root), _sized(spark, root), once=True, many=many)
    return found.select("crate", F.col("v")[0].alias("major"))


@audit(
    "version_order",
    """SELECT l_partkey, l_suppkey, l_linenumber, l_linenumber || '.' || l_partkey AS version,
      lpad(CAST(l_linenumber AS VARCHAR), 9, '0') || '.' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || '.000000000' AS sortable,
      l_linestatus = 'F' AS prerelease
    FROM lineitem""",
)
def version_order(spark: SparkSession, root: str) -> DataFrame:
    text = F.concat("l_linenumber", F.lit("."), "l_partkey")
    pre = F.when(F.col("l_linestatus") == "F", "-alpha.1+build-7").otherwise("+build-7")
    full = F.concat(text, pre)
    padded = F.transform(version_key(full), lambda n: F.lpad(n.cast("string"), 9, "0"))
    return table(spark, root, "lineitem").select(
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        text.alias("version"),
        F.array_join(padded, ".").alias("sortable"),
        is_prerelease(full).alias("prerelease"),
    )


# Gates over the documents: language, source and length as platform, length as version too.
GATES = {
    "simple": 'cfg(target_os = "en")',
    "both_hold": 'cfg(all(target_os = "en", target_arch = "src1"))',
    "nested": 'cfg(all(target_os = "en", any(target_arch = "src1", target_arch = "src2")))',
    "deep": 'cfg(any(target_os = "fr", all(target_arch = "src3", any(target_env = "long", target_os = "de"))))',
    "with_version": 'cfg(all(version = ">=1.0", target_os = "en"))',
    "two_versions": 'cfg(any(version = "<1", all(version = ">=1.2, <2", target_os = "de"), all(version = "^1", version = "~1.5", target_arch = "src4")))',
    "ungated": None,
}


@audit(
    "platform_gate",
    """SELECT doc_id,
      lang = 'en' AS simple,
      lang = 'en' AND source = 'src1' AS both_hold,
      lang = 'en' AND (source = 'src1' OR source = 'src2') AS nested,
      lang = 'fr' OR (source = 'src3' AND (n_chars > 1000 OR lang = 'de')) AS deep,
      lang = 'en' AND n_chars > 1000 AS with_version,
      n_chars <= 1000 OR lang = 'de' OR source = 'src4' AS two_versions,
      true AS ungated
    FROM documents""",
)
def platform_gate(spark: SparkSession, root: str) -> DataFrame:
    """Every document against every gate: its language, source and length are a platform, of which there are few."""
    size = F.when(F.col("n_chars") > 1000, "long").otherwise("short")
    key = F.concat_ws("|", "lang", "source", size)
    docs = table(spark, root, "documents").select("doc_id", "lang", "source", size.alias("size"), key.alias("platform"))
    facts = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(c).alias("value")) for a, c in zip(("target_os", "target_arch", "target_env"), ("lang", "source", "size"))])
    attributes = docs.select("platform", "lang", "source", "size").distinct().select("platform", F.inline(facts))
    texts = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(g).cast("string").alias("gate")) for n, g in GATES.items()])
    rows = docs.select("doc_id", "platform", version_key(F.when(F.col("size") == "long", "1.5.0").otherwise("0.1.0")).alias("v"), F.inline(texts))
    gates = spark.createDataFrame([(g,) for g in GATES.values()], "gate STRING")
    held = V.holding(rows, stage(V.clause_platforms(V.clause_table(gates), attributes), "clauses"))
    return held.groupBy("doc_id").agg(*[F.bool_or(F.col("name") == n).alias(n) for n in GATES])


# The gates of all parts of a brand and type are one crate's: sizes by five keys apart, and from each up to where its price says.
COVERAGE_SQL = """spans AS (
    SELECT DISTINCT p_brand || p_type AS crate, p_size AS lo, p_size + 1 + p_partkey % 4 AS hi FROM part WHERE p_partkey % 3 < 2),
  reached AS (SELECT *, max(hi) OVER (PARTITION BY crate ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM spans)"""


def _brand_gates(spark: SparkSession, root: str) -> DataFrame:
    parts = table(spark, root, "part").where("p_partkey % 3 < 2")
    gate = F.format_string('cfg(all(version = ">=%d, <%d", target_os = "linux"))', "p_size", F.col("p_size") + 1 + F.col("p_partkey") % 4)
    return V.gate_ranges(parts.select(F.concat("p_brand", "p_type").alias("crate"), gate.alias("gate")))


def _majors(ranges: DataFrame) -> DataFrame:
    return ranges.select("crate", *[F.col(side)[0].alias(side) for side in ("lo", "hi")])


@audit("coverage_gaps", f"WITH {COVERAGE_SQL} SELECT crate, CAST(reached AS BIGINT) AS lo, CAST(lo AS BIGINT) AS hi FROM reached WHERE reached < lo")
def coverage_gaps(spark: SparkSession, root: str) -> DataFrame:
    return _majors(V.coverage_gaps(_brand_gates(spark, root)))


@audit(
    "coverage_overlaps",
    f"WITH {COVERAGE_SQL} SELECT crate, CAST(lo AS BIGINT) AS lo, CAST(least(reached, hi) AS BIGINT) AS hi FROM reached WHERE reached > lo",
)
def coverage_overlaps(spark: SparkSession, root: str) -> DataFrame:
    return _majors(V.coverage_overlaps(_brand_gates(spark, root)))


@audit(
    "shadowed_sections",
    """WITH s AS (SELECT DISTINCT o_custkey AS crate, o_orderpriority AS key, o_orderkey AS section_no, o_orderkey % 7 AS lo, o_orderkey % 7 + 1 + o_orderkey % 3 AS hi FROM orders)
    SELECT DISTINCT crate, key, section_no FROM s a WHERE EXISTS (
      SELECT 1 FROM s b WHERE b.crate = a.crate AND b.key = a.key AND b.section_no > a.section_no AND b.lo <= a.lo AND b.hi >= a.hi)""",
)
def shadowed_sections(spark: SparkSession, root: str) -> DataFrame:
    """A customer's orders are sections, their keys give the versions they are for."""
    bound = lambda n: F.array(n.cast("bigint"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    low = F.col("o_orderkey") % 7
    sections = table(spark, root, "orders").select(
        F.col("o_custkey").alias("crate"), F.col("o_orderpriority").alias("key"), F.col("o_orderkey").alias("section_no"),
        bound(low).alias("lo"), bound(low + 1 + F.col("o_orderkey") % 3).alias("hi"),
    )
    return V.shadowed_sections(sections)


@audit(
    "gate_straddle",
    """WITH hits AS (
      SELECT o_custkey AS crate, o_orderpriority AS gate, CAST(year(o_orderdate) AS VARCHAR) AS slot,
        bool_or(o_totalprice > 250000) AS hit
      FROM orders GROUP BY ALL),
    changes AS (SELECT *, lag(hit) OVER (PARTITION BY crate, gate ORDER BY slot) AS was_hit FROM hits)
    SELECT crate, gate, slot, was_hit, hit FROM changes WHERE hit <> was_hit""",
)
def gate_straddle(spark: SparkSession, root: str) -> DataFrame:
    hits = table(spark, root, "orders").select(
        F.col("o_custkey").alias("crate"),
        F.col("o_orderpriority").alias("gate"),
        year_of("o_orderdate").alias("slot"),
        (F.col("o_totalprice") > 250000).alias("hit"),
    )
    return V.gate_straddle(hits)


@audit(
    "last_section",
    """WITH ranked AS (
      SELECT o_custkey, o_orderpriority, o_orderkey, row_number() OVER (
        PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
      FROM orders)
    SELECT o_custkey, o_orderpriority, o_orderkey FROM ranked WHERE r = 1""",
)
def last_section(spark: SparkSession, root: str) -> DataFrame:
    """A customer's orders are sections, the last one wins per priority."""
    return V.last_wins(table(spark, root, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey", ["o_orderdate", "o_orderkey"])


@audit(
    "unused_fixups",
    """SELECT p_partkey || '-' || (p_size % 10) AS crate FROM part
    WHERE p_partkey || '-' || (p_size % 10) NOT IN (SELECT l_partkey || '-' || (l_suppkey % 10) FROM lineitem)""",
)
def unused_fixups(spark: SparkSession, root: str) -> DataFrame:
    """A part with the last digit of its size is a crate; suppliers with this digit use it."""

    def crate(part: str, number: str) -> F.Column:
        return F.concat(part, F.lit("-"), F.col(number) % 10).alias("crate")

    return V.unused_fixups(
        table(spark, root, "part").select(crate("p_partkey", "p_size")),
        table(spark, root, "lineitem").select(crate("l_partkey", "l_suppkey")),
    )


# Directives ----------------------------------------------------------------------

# Customers are crates, nations are rigs. Each crate has a shared file of a base and two gated sections, and
# those of one market also have a local file in their nation's rig. A crate is used in its own rig and the next one.
DIRECTIVES_SQL = """files AS (
    SELECT c_custkey AS crate, c_nationkey AS rig, false AS is_local FROM customer
    UNION ALL SELECT c_custkey, c_nationkey, true FROM customer WHERE c_mktsegment = 'MACHINERY'),
  sections AS (
    SELECT crate, rig, is_local, 0 AS section_no, NULL AS gate, 'buildscript.run' AS key, 'bool' AS value_kind, 'false' AS value_json
    FROM files WHERE NOT is_local
    UNION ALL SELECT crate, rig, is_local, 0, NULL, 'cargo_env', 'array', '["A", "B"]' FROM files WHERE NOT is_local
    UNION ALL SELECT crate, rig, is_local, 1, 'cfg(version = ">=' || rig || '.5")', 'buildscript.run', 'bool', 'true'
    FROM files WHERE NOT is_local
    UNION ALL SELECT crate, rig, is_local, 2, 'cfg(all(version = "<12", target_os = "linux"))', 'cargo_env', 'bool', 'true'
    FROM files WHERE NOT is_local
    UNION ALL SELECT crate, rig, is_local, 0, NULL, 'overlay', 'string', '"local-' || rig || '"' FROM files WHERE is_local)"""


def _directives(spark: SparkSession, root: str) -> DataFrame:
    """Directive files as TOML, one per customer, read by the reader of such files."""
    rig = F.col("c_nationkey").cast("string")
    shared = F.format_string(
        'buildscript.run = false\ncargo_env = ["A", "B"]\n[\'cfg(version = ">=%s.5")\']\nbuildscript.run = true\n'
        '[\'cfg(all(version = "<12", target_os = "linux"))\']\ncargo_env = true\n',
        rig,
    )
    crate = F.concat(F.lit("/"), "c_custkey")
    customers = balanced(table(spark, root, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")
    own = F.when(
        F.col("c_mktsegment") == "MACHINERY",
        F.struct(F.concat(rig, crate).alias("source"), F.format_string('overlay = "local-%s"\n', rig).alias("content")),
    )
    files = F.array_compact(F.array(F.struct(crate.alias("source"), shared.alias("content")), own))
    texts = customers.select(F.inline(files))
    rows = SM.parse_fixup_directives(texts)
    return rows.select(
        F.substring_index("source", "/", 1).alias("rig_scope"), F.substring_index("source", "/", -1).alias("crate"), *rows.columns[1:]
    )


def _uses(spark: SparkSession, root: str) -> DataFrame:
    """Each crate in two rigs, at a version by its account balance."""
    major = F.floor(F.col("c_acctbal") / 500).cast("int")
    rigs = F.explode(F.array("c_nationkey", (F.col("c_nationkey") + 1) % 25)).alias("rig")
    customers = table(spark, root, "customer").where(major >= 0)
    return customers.select(
        rigs, F.col("c_custkey").cast("string").alias("crate"), F.format_string("%d.%d.0", major, F.col("c_nationkey")).alias("version")
    ).withColumn("rig", F.col("rig").cast("string"))


@audit(
    "fixup_directives",
    f"""WITH {DIRECTIVES_SQL} SELECT CASE WHEN is_local THEN CAST(rig AS VARCHAR) ELSE '' END AS rig_scope,
      CAST(crate AS VARCHAR) AS crate, section_no, gate, key, value_kind, value_json FROM sections""",
)
def fixup_directives(spark: SparkSession, root: str) -> DataFrame:
    return _directives(spark, root)


USES_SQL = """uses AS (
    SELECT r.rig, c_custkey AS crate, c_nationkey AS minor, CAST(floor(c_acctbal / 500) AS INTEGER) AS major
    FROM customer, (VALUES (0), (1)) AS step(n), LATERAL (SELECT (c_nationkey + n) % 25 AS rig) r
    WHERE floor(c_acctbal / 500) >= 0),
  in_force AS (
    SELECT CAST(u.rig AS VARCHAR) AS rig, CAST(u.crate AS VARCHAR) AS crate, major, minor, s.rig AS nation, section_no, key, value_json
    FROM uses u JOIN sections s ON s.crate = u.crate
    WHERE s.is_local = EXISTS (SELECT 1 FROM files f WHERE f.is_local AND f.crate = u.crate AND f.rig = u.rig))"""


@audit(
    "resolve_override",
    f"""WITH {DIRECTIVES_SQL}, {USES_SQL}
    SELECT rig, crate, section_no, key, value_json FROM in_force""",
)
def resolve_override(spark: SparkSession, root: str) -> DataFrame:
    in_force = V.resolve_override(stage(_directives(spark, root), "directives"), _uses(spark, root))
    return in_force.select("rig", "crate", "section_no", "key", "value_json")


PLATFORMS = (("linux-x86", "linux", "x86_64", "gnu"), ("mac-arm", "macos", "aarch64", ""))


@audit(
    "effective_directives",
    f"""WITH {DIRECTIVES_SQL}, {USES_SQL}, platforms(platform, os) AS (VALUES ('linux-x86', 'linux'), ('mac-arm', 'macos')),
    holding AS (
      SELECT rig, crate, major || '.' || minor || '.0' AS version, platform, key, value_json, section_no
      FROM in_force CROSS JOIN platforms
      WHERE section_no = 0
        OR (section_no = 1 AND (major > nation OR (major = nation AND minor >= 5)))
        OR (section_no = 2 AND major < 12 AND os = 'linux'))
    SELECT rig, crate, version, platform, key, arg_max(value_json, section_no) AS value_json FROM holding GROUP BY ALL""",
)
def effective_directives(spark: SparkSession, root: str) -> DataFrame:
    return V.effective_directives(stage(_directives(spark, root), "directives"), _uses(spark, root), PLATFORMS)


@audit(
    "directive_views",
    f"""WITH {DIRECTIVES_SQL} SELECT CAST(crate AS VARCHAR) AS crate, section_no, value_json AS run,
      NULL AS all_names, NULL AS names FROM sections WHERE key = 'buildscript.run'
    UNION ALL SELECT CAST(crate AS VARCHAR), section_no, NULL, CAST(value_json = 'true' AS VARCHAR),
      CASE WHEN value_kind = 'array' THEN 'A B' END
    FROM sections WHERE key = 'cargo_env'""",
)
def directive_views(spark: SparkSession, root: str) -> DataFrame:
    directives = stage(_directives(spark, root), "directives")
    runs = SM.build_script_view(directives).select("crate", "section_no", F.col("run").cast("string").alias("run"))
    envs = SM.cargo_env_view(directives).select("crate", "section_no", F.col("all_names").cast("string").alias("all_names"), F.array_join("names", " ").alias("names"))
    return runs.unionByName(envs, allowMissingColumns=True)


# Target files ----------------------------------------------------------------------

# Every part as a target file: an archive, a library that needs it, and by size one
# that is renamed or needed on one platform only.
TARGET_SQL = f"""files AS (SELECT p_partkey, {CRATE_SQL} || '-' || p_size AS name, p_size FROM part)"""


def _target_texts(spark: SparkSession, root: str) -> DataFrame:
    name = F.concat(crate_name(), F.lit("-"), "p_size")
    content = F.concat(
        F.lit('# generated\nload("@x//y.bzl", "cargo")\n\n'),
        F.format_string('http_archive(\n    name = "%s.crate",\n    urls = ["https://host/%s"],\n)\n\n', name, name),
        F.format_string('cargo.rust_library(\n    name = "%s",\n    srcs = [":%s.crate"],\n    crate = "%s",\n', name, name, crate_name()),
        F.lit('    edition = "2021",\n    features = [\n        "default",\n        "std",\n    ],\n'),
        F.when(F.col("p_size") > 25, F.format_string('    named_deps = {"other": ":alias-%d"},\n', "p_size")).otherwise(""),
        F.when(
            F.col("p_size") < 5, '    platform = {\n        "linux-arm64": dict(\n            deps = [":libc-0.2"],\n        ),\n    },\n'
        ).otherwise(""),
        F.format_string('    deps = [":base-%d", "//other:x"],\n)\n', F.col("p_size")),
    )
    source = F.concat(F.lit("pkg/"), F.col("p_partkey").cast("string"))
    parts = table(spark, root, "part").select("p_partkey", "p_name", "p_size")
    return balanced(parts, "p_partkey").select(source.alias("source"), content.alias("content"))


@audit(
    "target_inventory",
    f"""WITH {TARGET_SQL} SELECT 'pkg/' || p_partkey AS source, 'http_archive' AS kind, name || '.crate' AS name,
      NULL AS crate, NULL AS edition, '' AS features FROM files
    UNION ALL SELECT 'pkg/' || p_partkey, 'cargo.rust_library', name, regexp_replace(name, '-[0-9]*$', ''), '2021', 'default,std'
    FROM files""",
)
def target_inventory(spark: SparkSession, root: str) -> DataFrame:
    targets = parse_targets(_target_texts(spark, root))
    return targets.select("source", "kind", "name", "crate", "edition", F.array_join("features", ",").alias("features"))


@audit(
    "target_edges",
    f"""WITH {TARGET_SQL}, libraries AS (SELECT 'pkg/' || p_partkey AS package, 'pkg/' || p_partkey || ':' || name AS src, p_size FROM files)
    SELECT src, package || ':base-' || p_size AS dst, NULL AS platform FROM libraries
    UNION ALL SELECT src, '//other:x', NULL FROM libraries
    UNION ALL SELECT src, package || ':alias-' || p_size, NULL FROM libraries WHERE p_size > 25
    UNION ALL SELECT src, package || ':libc-0.2', 'linux-arm64' FROM libraries WHERE p_size < 5""",
)
def edges_of_targets(spark: SparkSession, root: str) -> DataFrame:
    targets = parse_targets(_target_texts(spark, root))
    return target_edges(targets.withColumn("label", F.concat_ws(":", "source", "name")))
