"""Sources and sinks over files that Spark writes from the given tables.

The files go to a fresh folder in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import impact as I
from ..operators import manifests as M
from ..operators import reconcile as R
from ..session import scratch_path, stage
from ..sinks import text as K
from ..sources import sweeps as SS
from ..sources import targets as ST
from ..sources.run_folders import read_run_folders
from .changes import CRATES_SQL, PATHS_SQL, paths
from .inputs import KNOWN_SQL, LABEL_SQL, PLAIN_SQL, balanced, known, label, labels_of, table
from .registry import audit
from .versions import DEPS_SQL, SKIPPED, manifest_deps_of


@audit(
    "known_failure_files",
    f"""SELECT DISTINCT l_returnflag AS platform, {PLAIN_SQL} AS label FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def known_failure_files(spark: SparkSession, root: str) -> DataFrame:
    """Lists per platform, each label under a comment and an empty line."""
    out = scratch_path(spark, "known")
    lines = table(spark, root, "lineitem").withColumn("platform", F.col("l_returnflag"))
    labels = labels_of(lines, table(spark, root, "part"), "platform").distinct()
    entry = F.explode(F.array(F.concat(F.lit("# "), "label"), F.lit(""), "label"))
    labels.select("platform", entry.alias("line")).write.partitionBy("platform").text(out)
    return SS.read_known_failures(spark, out, r"platform=([^/]*)/", "*.txt")


@audit(
    "build_report_files",
    """SELECT event_type AS platform, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS run_id,
      'fixups//users:' || user_id AS label, count(*) AS n
    FROM events WHERE nullif(event_type, 'view') IS NULL OR value > 20 GROUP BY ALL""",
)
def build_report_files(spark: SparkSession, root: str) -> DataFrame:
    """An event is a report, its week a run, its type a platform; views have no outcome."""
    out = scratch_path(spark, "reports")
    good = F.when(F.col("value") > 20, "FAIL").otherwise("SUCCESS")
    outcome = F.struct(F.when(F.col("event_type") != "view", good).alias("success"))
    name = F.concat(F.lit("fixups//users:"), "user_id", F.lit("#cfg"))
    reports = table(spark, root, "events").select(
        "event_id",
        F.col("event_type").alias("platform"),
        F.to_date(F.date_trunc("week", "ts")).cast("string").alias("run_id"),
        F.create_map(name, outcome).alias("results"),
    )
    reports.repartitionByRange("platform", "run_id", "event_id").drop("event_id").write.partitionBy("platform", "run_id").json(out)
    read = SS.read_build_reports(spark, out, r"platform=([^/]+)/run_id=([^/]+)/[^/]+$", multi_line=False)
    staged = scratch_path(spark, "staged")
    SS.stage_reports(read, staged)
    observed = R.observed_failures(spark.read.parquet(staged))
    return observed.groupBy("platform", F.col("run_id").cast("string").alias("run_id"), "label").agg(F.count("*").alias("n"))


@audit(
    "report_run_states",
    """SELECT DISTINCT event_type AS platform, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS run_id,
      CASE WHEN event_type = 'error' AND week(ts) % 2 = 0 THEN 'cancelled'
        WHEN week(ts) % 3 = 0 THEN 'read' ELSE 'unreadable' END AS state
    FROM events""",
)
def report_run_states(spark: SparkSession, root: str) -> DataFrame:
    """One report file per event type and week: without results, cut off, or empty; some were cancelled."""
    out = scratch_path(spark, "reports")
    week = F.weekofyear("ts")
    text = F.when(week % 3 == 0, "{}").when(week % 3 == 1, '{"results": {"fixups//a:b": {"succ').otherwise("")
    runs = table(spark, root, "events").select(
        F.col("event_type").alias("platform"),
        F.to_date(F.date_trunc("week", "ts")).cast("string").alias("run_id"),
        text.alias("text"),
        ((F.col("event_type") == "error") & (week % 2 == 0)).alias("cancelled"),
    ).distinct()
    runs.drop("cancelled").write.partitionBy("platform", "run_id").text(out)
    at = r"platform=([^/]+)/run_id=([^/]+)/[^/]+$"
    reports = stage(SS.read_report_files(spark, out, at, glob="part-*"), "parsed").select("run_id", "platform", "broken")
    cancelled = runs.where("cancelled").select("run_id", "platform")
    return SS.run_states(SS.read_runs(spark, out, at, "part-*"), reports, cancelled)


FOLDER_REPORTS_SQL = """reports AS (
    SELECT l_linestatus AS platform, CAST(year(l_shipdate) AS VARCHAR) AS run_id, l_suppkey // 10 AS part, 'fixups//p:' || l_partkey || '-' || l_suppkey AS label,
      bool_or(l_returnflag = 'R') AS bad, bool_or(l_returnflag = 'A') AS none
    FROM lineitem GROUP BY ALL)"""


SHARES = 8  # of a run, whose files grow with the suppliers


def _report_folders(spark: SparkSession, root: str) -> str:
    """A report per platform, run and ten suppliers, with a result per part; some have no outcome. One more per run is cut off."""
    out = scratch_path(spark, "folders")
    label = F.concat(F.lit("fixups//p:"), "l_partkey", F.lit("-"), "l_suppkey")
    flags = table(spark, root, "lineitem").groupBy(
        F.col("l_linestatus").alias("platform"), F.year("l_shipdate").cast("string").alias("run_id"), F.expr("l_suppkey div 10").alias("part"), label.alias("label")
    ).agg(F.bool_or(F.col("l_returnflag") == "R").alias("bad"), F.bool_or(F.col("l_returnflag") == "A").alias("none"))
    outcome = F.struct(F.when(~F.col("none"), F.when(F.col("bad"), "FAIL").otherwise("SUCCESS")).alias("success"))
    # A file holds what ten suppliers delivered in a year, so a group's size does not grow with their number.
    each = flags.groupBy("platform", "run_id", "part").agg(F.map_from_entries(F.collect_list(F.struct("label", outcome))).alias("results"))
    whole = each.select("platform", "run_id", F.col("part").cast("string").alias("part"), F.to_json(F.struct("results")).alias("text"))
    cut = flags.select("platform", "run_id").distinct().select("platform", "run_id", F.lit("cut").alias("part"), F.lit('{"results": {"x').alias("text"))
    # A file each: written by all tasks, which also put them in place, as the driver would one by one.
    files = balanced(whole.unionByName(cut), "platform", "run_id", "part").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    files.partitionBy("platform", "run_id", "part").text(out)
    return out


@audit(
    "folder_reports",
    f"""WITH {FOLDER_REPORTS_SQL} SELECT platform, run_id, label, CASE WHEN none THEN NULL WHEN bad THEN 'FAIL' ELSE 'SUCCESS' END AS success
    FROM reports WHERE platform = 'F' AND run_id IN ('1996', '1998', '2003')""",
)
def folder_reports(spark: SparkSession, root: str) -> DataFrame:
    """Reports of some runs of one platform; other folders are not opened."""
    rows = read_run_folders(spark, _report_folders(spark, root), suffix=".txt", shares=SHARES).where("label IS NOT NULL")
    return rows.where((F.col("platform") == "F") & F.col("run_id").isin("1996", "1998", "2003")).select("platform", "run_id", "label", "success")


@audit(
    "folder_run_states",
    f"""WITH {FOLDER_REPORTS_SQL}, files AS (SELECT DISTINCT platform, run_id, part FROM reports)
    SELECT platform, run_id, 'read' AS state, count(*) AS n FROM files GROUP BY ALL
    UNION ALL SELECT DISTINCT platform, run_id, 'unreadable', CAST(1 AS BIGINT) FROM files""",
)
def folder_run_states(spark: SparkSession, root: str) -> DataFrame:
    rows = read_run_folders(spark, _report_folders(spark, root), suffix=".txt", shares=SHARES).where("label IS NULL")
    return rows.groupBy("platform", "run_id", "state").agg(F.count("*").alias("n"))


@audit("changed_path_files", f"WITH {PATHS_SQL}, {CRATES_SQL} SELECT crate FROM crates")
def changed_path_files(spark: SparkSession, root: str) -> DataFrame:
    out = scratch_path(spark, "paths")
    paths(spark, root).write.text(out)
    return I.changed_crates(SS.read_changed_paths(spark, out))


@audit("target_table", f"SELECT {LABEL_SQL} AS label, p_type AS kind FROM part WHERE p_type IN ('PROMO', 'SMALL')")
def target_table(spark: SparkSession, root: str) -> DataFrame:
    out = scratch_path(spark, "targets")
    table(spark, root, "part").select(label().alias("label"), F.col("p_type").alias("kind"), "p_size").write.parquet(out)
    return I.of_kind(ST.read_targets(spark, out), ["PROMO", "SMALL"])


@audit("label_line_files", f"WITH {KNOWN_SQL} SELECT label AS line FROM known")
def label_line_files(spark: SparkSession, root: str) -> DataFrame:
    out = scratch_path(spark, "labels")
    K.write_label_lines(known(spark, root), out)
    return spark.read.text(out).withColumnRenamed("value", "line")


@audit(
    "manifest_files",
    f"""WITH {DEPS_SQL} SELECT slot, count(*) AS n_lines, count(*) FILTER (has_features) AS n_features,
      count(*) FILTER (no_default) AS n_without_default FROM deps GROUP BY slot""",
)
def manifest_files(spark: SparkSession, root: str) -> DataFrame:
    out = scratch_path(spark, "manifests")
    K.write_manifests(M.float_deps(manifest_deps_of(spark, root), SKIPPED), out)
    lines = spark.read.text(out).withColumn("slot", F.col("slot").cast("string"))
    return lines.groupBy("slot").agg(
        F.count("*").alias("n_lines"),
        F.count_if(F.col("value").contains("features = [")).alias("n_features"),
        F.count_if(F.col("value").contains("default-features = false")).alias("n_without_default"),
    )
