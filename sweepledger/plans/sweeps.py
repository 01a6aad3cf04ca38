"""Sweep reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import CANCEL_TEXT
from ..functions import labels as L
from ..functions.outcomes import index_is_faithful, not_success, platform_key
from ..operators import reconcile as R
from ..operators.setops import except_distinct, union_distinct
from ..session import scratch_path, stage
from ..sinks.text import label_lines, verdict_lines, write_arg_strings
from ..sources.sweeps import parse_reports
from .inputs import KNOWN_SQL, LABEL_SQL, OBSERVED_SQL, PLAIN_SQL, known, label, observed, sightings, table, year_of
from .registry import audit

STATUS_SQL = """
  coalesce(o.label, k.label) AS label,
  CASE WHEN o.label IS NULL THEN 'stale' WHEN k.label IS NULL THEN 'new' ELSE 'known' END AS status
"""


@audit(
    "reconcile_status",
    f"WITH {OBSERVED_SQL}, {KNOWN_SQL} SELECT {STATUS_SQL} FROM observed o FULL JOIN known k ON o.label = k.label",
)
def reconcile_status(spark: SparkSession, root: str) -> DataFrame:
    return R.reconcile_flagged(sightings(spark, root), ["label"])


@audit(
    "new_failures",
    f"WITH {OBSERVED_SQL}, {KNOWN_SQL} SELECT label FROM observed EXCEPT SELECT label FROM known",
)
def new_failures(spark: SparkSession, root: str) -> DataFrame:
    return R.new_failures(observed(spark, root), known(spark, root), ["label"])


@audit(
    "stale_entries",
    f"WITH {OBSERVED_SQL}, {KNOWN_SQL} SELECT label FROM known EXCEPT SELECT label FROM observed",
)
def stale_entries(spark: SparkSession, root: str) -> DataFrame:
    return R.stale_entries(observed(spark, root), known(spark, root), ["label"])


SCOPE = ("//economy/...", "//small:")


@audit(
    "scoped_reconcile",
    f"""WITH {OBSERVED_SQL}, {KNOWN_SQL}
    SELECT {STATUS_SQL} FROM observed o
    FULL JOIN (SELECT * FROM known WHERE regexp_matches(label, '^//economy[/:]|^//small:')) k ON o.label = k.label""",
)
def scoped_reconcile(spark: SparkSession, root: str) -> DataFrame:
    """Only the known side is scoped, so known labels out of scope come out as new."""
    return R.reconcile(observed(spark, root), R.scope_known(known(spark, root), SCOPE, cell=""), ["label"])


# Patterns of all four forms, taken from the parts.
PATTERNS_SQL = f"""patterns AS (
  SELECT DISTINCT CASE
    WHEN p_size = 50 THEN {PLAIN_SQL}
    WHEN p_type = 'PROMO' THEN '//promo/...'
    WHEN p_type = 'SMALL' THEN '//small:'
    WHEN p_type = 'LARGE' THEN '//large/inner+' || p_size || '.x'
    ELSE '//none:' END AS pattern
  FROM part)"""
def _plain_sql(text: str) -> str:
    return f"regexp_replace({text}, '([.+*?()\\[\\]{{}}|^$\\\\])', '\\\\\\1', 'g')"


REGEX_SQL = f"""CASE
    WHEN pattern LIKE '%/...' THEN '^' || {_plain_sql("left(pattern, length(pattern) - 4)")} || '[/:]'
    WHEN pattern LIKE '%:' THEN '^' || {_plain_sql("pattern")}
    WHEN contains(pattern, ':') THEN '^' || {_plain_sql("pattern")} || '$'
    ELSE '^' || {_plain_sql("pattern")} || '[/:]' END"""


def _patterns(spark: SparkSession, root: str) -> DataFrame:
    pattern = (
        F.when(F.col("p_size") == 50, L.strip_config(label()))
        .when(F.col("p_type") == "PROMO", "//promo/...")
        .when(F.col("p_type") == "SMALL", "//small:")
        .when(F.col("p_type") == "LARGE", F.format_string("//large/inner+%d.x", "p_size"))
        .otherwise("//none:")
    )
    return table(spark, root, "part").select(pattern.alias("pattern")).distinct()


@audit("pattern_to_scope", f"WITH {PATTERNS_SQL} SELECT pattern, {REGEX_SQL} AS scope FROM patterns")
def pattern_to_scope(spark: SparkSession, root: str) -> DataFrame:
    return _patterns(spark, root).withColumn("scope", L.scope_regex(F.col("pattern"), cell=""))


@audit(
    "scope_by_table",
    f"""WITH {KNOWN_SQL}, {PATTERNS_SQL}, scopes AS (SELECT {REGEX_SQL} AS scope FROM patterns)
    SELECT label FROM known WHERE EXISTS (SELECT 1 FROM scopes WHERE regexp_matches(label, scope))""",
)
def scope_by_table(spark: SparkSession, root: str) -> DataFrame:
    return R.scope_to(known(spark, root).distinct(), _patterns(spark, root), cell="")


@audit(
    "sweep_verdict",
    f"""WITH {OBSERVED_SQL}, {KNOWN_SQL},
    statuses AS (SELECT {STATUS_SQL} FROM observed o FULL JOIN known k ON o.label = k.label),
    counts AS (
      SELECT split_part(label, ':', 1) AS package,
        count(*) FILTER (status = 'new') AS new_count,
        count(*) FILTER (status = 'stale') AS stale_count,
        count(*) FILTER (status <> 'new') AS known_count
      FROM statuses GROUP BY 1)
    SELECT *, CASE WHEN new_count > 0 THEN 'fail' WHEN stale_count > 0 THEN 'warn' ELSE 'ok' END AS verdict
    FROM counts""",
)
def sweep_verdict(spark: SparkSession, root: str) -> DataFrame:
    statuses = R.reconcile_flagged(sightings(spark, root), ["label"])
    return R.verdicts(statuses.withColumn("package", L.package_of(F.col("label"))), ["package"], is_ci=False)


# Runs are years, platforms are line states, labels are parts at a supplier. Returned lines failed in their
# run; those accepted in any year are on the platform's list.
RUN_LABEL_SQL = f"{PLAIN_SQL} || '-s' || l_suppkey"
RUNS_SQL = f"""lines AS (
    SELECT CAST(year(l_shipdate) AS VARCHAR) AS run_id, l_linestatus AS platform, l_returnflag, {RUN_LABEL_SQL} AS label
    FROM lineitem JOIN part ON l_partkey = p_partkey),
  runs AS (SELECT DISTINCT run_id, platform FROM lines),
  sides AS (
    SELECT run_id, platform, label, true AS seen, false AS listed FROM lines WHERE l_returnflag = 'R'
    UNION ALL
    SELECT r.run_id, r.platform, l.label, false, true FROM runs r
      JOIN (SELECT DISTINCT platform, label FROM lines WHERE l_returnflag = 'A') l ON l.platform = r.platform),
  statuses AS (
    SELECT run_id, platform, label,
      CASE WHEN bool_or(seen) AND bool_or(listed) THEN 'known' WHEN bool_or(seen) THEN 'new' ELSE 'stale' END AS status
    FROM sides GROUP BY run_id, platform, label),
  verdicts AS (
    SELECT r.run_id, r.platform,
      count(*) FILTER (status = 'new') AS new_count,
      count(*) FILTER (status = 'stale') AS stale_count,
      count(*) FILTER (status IN ('known', 'stale')) AS known_count,
      CASE WHEN count(*) FILTER (status IN ('new', 'stale')) > 0 THEN 'fail' ELSE 'ok' END AS verdict
    FROM runs r LEFT JOIN statuses s ON s.run_id = r.run_id AND s.platform = r.platform
    GROUP BY r.run_id, r.platform)"""


def _runs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Failures, lists and runs, from one pass over the line items that is written once."""
    flagged = (
        table(spark, root, "lineitem")
        .groupBy("l_partkey", "l_suppkey", F.col("l_linestatus").alias("platform"), year_of("l_shipdate").alias("run_id"))
        .agg(
            F.bool_or(F.col("l_returnflag") == "R").alias("seen"),
            F.bool_or(F.col("l_returnflag") == "A").alias("listed"),
        )
        .join(table(spark, root, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.concat(L.strip_config(label()), F.lit("-s"), "l_suppkey").alias("label"), "platform", "run_id", "seen", "listed")
    )
    sides = stage(flagged, "sides")
    seen = sides.where("seen").select("run_id", "platform", "label")
    return seen, sides.where("listed").select("platform", "label"), sides.select("run_id", "platform").distinct()


@audit("run_verdicts", f"WITH {RUNS_SQL} SELECT * FROM verdicts")
def run_verdicts(spark: SparkSession, root: str) -> DataFrame:
    return R.run_verdicts(*_runs(spark, root), is_ci=True)


@audit(
    "verdict_lines",
    f"""WITH {RUNS_SQL}
    SELECT run_id, platform, 0 AS part, verdict AS kind, CAST(NULL AS VARCHAR) AS label, known_count FROM verdicts
    UNION ALL
    SELECT run_id, platform, CASE status WHEN 'new' THEN 1 ELSE 2 END, status, label, CAST(NULL AS BIGINT)
    FROM statuses WHERE status <> 'known'""",
)
def verdict_report(spark: SparkSession, root: str) -> DataFrame:
    """The whole report of every run: each has a line per stale entry of its own."""
    failures, listed, runs = _runs(spark, root)
    seen = stage(R.judged(failures, listed), "judged")
    stale = R.stale_per_run(failures, listed, runs)
    return verdict_lines(R.verdicts_of(seen, listed, runs, is_ci=True), seen, None, stale).drop("n_runs")


@audit(
    "stale_in_runs",
    f"""WITH {RUNS_SQL}
    SELECT run_id, platform, label FROM statuses WHERE status = 'stale' AND run_id = (SELECT max(run_id) FROM runs)""",
)
def stale_of_last_run(spark: SparkSession, root: str) -> DataFrame:
    """Stale entries by name, of the last year's runs."""
    failures, listed, runs = _runs(spark, root)
    seen = stage(R.judged(failures, listed), "judged")
    last = runs.join(runs.agg(F.max("run_id").alias("run_id")), "run_id", "left_semi")
    return R.stale_in_runs(seen, R.stale_classes(seen, listed, runs), last)


@audit(
    "target_count",
    f"""SELECT split_part({LABEL_SQL}, ':', 1) AS package, count(*) AS target_count
    FROM part WHERE regexp_matches({LABEL_SQL}, '^//economy[/:]|^//small:') GROUP BY 1""",
)
def target_count(spark: SparkSession, root: str) -> DataFrame:
    targets = table(spark, root, "part").select(label().alias("label"))
    scoped = R.scope_known(targets, SCOPE, cell="").withColumn("package", L.package_of(F.col("label")))
    return R.target_count(scoped, ["package"])


@audit(
    "known_count",
    f"WITH {KNOWN_SQL} SELECT split_part(label, ':', 1) AS package, count(*) AS known_count FROM known GROUP BY 1",
)
def known_count(spark: SparkSession, root: str) -> DataFrame:
    return R.known_count(known(spark, root).withColumn("package", L.package_of(F.col("label"))), ["package"])


# Reports and logs ----------------------------------------------------------------


@audit(
    "not_success_events",
    "SELECT event_id, event_type FROM events WHERE nullif(event_type, 'view') IS DISTINCT FROM 'click'",
)
def not_success_events(spark: SparkSession, root: str) -> DataFrame:
    """A click is a success, a view has no outcome at all and failed."""
    outcome = F.nullif(F.col("event_type"), F.lit("view"))
    return table(spark, root, "events").where(not_success(outcome, ok="click")).select("event_id", "event_type")


@audit(
    "report_failures",
    """SELECT event_id, 'fixups//users:' || user_id AS label FROM events WHERE event_type IN ('error', 'view')
    UNION ALL SELECT event_id, 'fixups//pages:' || user_id FROM events WHERE event_type IN ('error', 'purchase')""",
)
def report_failures(spark: SparkSession, root: str) -> DataFrame:
    """Each event as a JSON report of two labels; sign-ups have no results."""
    user, kind = F.col("user_id").cast("string"), F.col("event_type")

    def entry(place: str, outcome) -> F.Column:
        return F.concat(F.lit(f'"fixups//{place}:'), user, F.lit('#cfg": '), outcome)

    bad, good = F.lit('{"success": "FAIL"}'), F.lit('{"success": "SUCCESS"}')
    users = F.when(kind == "error", bad).when(kind == "view", F.lit("{}")).otherwise(good)
    pages = F.when(kind.isin("error", "purchase"), bad).otherwise(good)
    content = F.when(kind == "signup", F.lit("{}")).otherwise(
        F.concat(F.lit('{"results": {'), entry("users", users), F.lit(", "), entry("pages", pages), F.lit("}}"))
    )
    reports = table(spark, root, "events").select("event_id", content.alias("content"))
    return R.observed_failures(parse_reports(reports))


@audit(
    "json_metric",
    """SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total
    FROM events GROUP BY 1""",
)
def json_metric(spark: SparkSession, root: str) -> DataFrame:
    metrics = table(spark, root, "events").select("event_type", F.explode(F.from_json("props", "MAP<STRING, BIGINT>")))
    return metrics.where("key = 'k'").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@audit(
    "index_is_faithful",
    "SELECT page_id, page_id IS NOT NULL AND contains(url, 'example.org') AS faithful FROM pages",
)
def faithful_index(spark: SparkSession, root: str) -> DataFrame:
    config = F.to_json(F.struct(F.col("url").alias("dl")))
    return table(spark, root, "pages").select("page_id", index_is_faithful(config, "example.org").alias("faithful"))


@audit(
    "cancelled_runs",
    """SELECT event_id FROM events e WHERE NOT EXISTS (
      SELECT 1 FROM events x WHERE x.event_type = 'error' AND x.user_id = e.user_id
        AND CAST(x.ts AS DATE) = CAST(e.ts AS DATE))""",
)
def cancelled(spark: SparkSession, root: str) -> DataFrame:
    """A user's day is a run; an error event cancels it."""
    events = table(spark, root, "events").select(
        "event_id", F.col("user_id").alias("run_id"), F.to_date("ts").alias("platform"), "event_type"
    )
    notice = F.when(F.col("event_type") == "error", CANCEL_TEXT).otherwise("")
    return R.drop_cancelled(events, events.withColumn("line", notice)).select("event_id")


@audit(
    "platform_key",
    """WITH d AS (
      SELECT doc_id,
        CASE lang WHEN 'en' THEN 'MINGW64_NT-10.0-20348' WHEN 'es' THEN 'MSYS_NT-10.0' WHEN 'fr' THEN 'Darwin' ELSE 'Linux' END AS os,
        CASE WHEN source = 'src3' THEN 'ARM64' WHEN source = 'src4' THEN 'X64' END AS runner
      FROM documents)
    SELECT doc_id, CASE WHEN regexp_matches(os, '^(MINGW|MSYS|CYGWIN)')
      THEN 'Windows-' || CASE runner WHEN 'ARM64' THEN 'aarch64' WHEN 'X64' THEN 'x86_64' ELSE 'arm64' END
      ELSE os || '-arm64' END AS platform
    FROM d""",
)
def platform_keys(spark: SparkSession, root: str) -> DataFrame:
    os = (
        F.when(F.col("lang") == "en", "MINGW64_NT-10.0-20348")
        .when(F.col("lang") == "es", "MSYS_NT-10.0")
        .when(F.col("lang") == "fr", "Darwin")
        .otherwise("Linux")
    )
    runner = F.when(F.col("source") == "src3", "ARM64").when(F.col("source") == "src4", "X64")
    return table(spark, root, "documents").select("doc_id", platform_key(os, F.lit("arm64"), runner).alias("platform"))


# Sinks and set operations ----------------------------------------------------------


@audit("label_lines", f"WITH {KNOWN_SQL} SELECT label FROM known")
def sorted_labels(spark: SparkSession, root: str) -> DataFrame:
    return label_lines(known(spark, root))


@audit(
    "arg_string_by_package",
    f"""SELECT DISTINCT split_part({PLAIN_SQL}, ':', 1) AS package, {PLAIN_SQL} AS label FROM part""",
)
def arg_strings(spark: SparkSession, root: str) -> DataFrame:
    plain = L.strip_config(label())
    targets = table(spark, root, "part").select(L.package_of(plain).alias("package"), plain.alias("label"))
    out = scratch_path(spark, "args")
    write_arg_strings(targets, out, ["package"])
    read = spark.read.schema("value STRING, package STRING").option("lineSep", " ").text(out)
    return read.select("package", F.col("value").alias("label"))


@audit(
    "target_union",
    f"""SELECT {LABEL_SQL} AS label FROM part WHERE p_type = 'PROMO'
    UNION SELECT {LABEL_SQL} FROM part WHERE p_size > 25""",
)
def target_union(spark: SparkSession, root: str) -> DataFrame:
    parts = table(spark, root, "part")
    return union_distinct([parts.where(c).select(label().alias("label")) for c in ("p_type = 'PROMO'", "p_size > 25")])


@audit(
    "target_except",
    f"""SELECT {LABEL_SQL} AS label FROM part WHERE p_type = 'PROMO'
    EXCEPT SELECT {LABEL_SQL} FROM part WHERE p_size > 25""",
)
def target_except(spark: SparkSession, root: str) -> DataFrame:
    parts = table(spark, root, "part")
    return except_distinct(
        *[parts.where(c).select(label().alias("label")) for c in ("p_type = 'PROMO'", "p_size > 25")]
    )
