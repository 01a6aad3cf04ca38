"""Lines of lists and logs, with the documents as files, one per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import loglines as G
from ..sources.files import number_lines
from .inputs import table
from .registry import audit

# A final line feed ends the last line and starts none.
def lines_sql(text: str = "text") -> str:
    return rf"""raw AS (SELECT doc_id, {text} AS text FROM documents),
  texts AS (
    SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END AS text FROM raw),
  arrays AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM texts),
  lines AS (
    SELECT doc_id, CAST(unnest(range(1, len(parts) + 1)) AS INTEGER) AS line_no, unnest(parts) AS line FROM arrays)"""


LINES_SQL = lines_sql()

# Words of the documents in the place of resolver messages.
WORD_PATTERNS = (
    r"^.*under the ([A-Za-z0-9.-]+) [Ll]icense",
    r"^.*https?://([^/ ]+)",
    r"^.*[Tt]ion ([a-z]+) of",
    r"^.*was ([a-z]+) by",
)
BLAME_SQL = "coalesce({})".format(", ".join(f"nullif(regexp_extract(line, '{p}', 1), '')" for p in WORD_PATTERNS))
FIRST_BLAME_SQL = f"""WITH {LINES_SQL}, blamed AS (SELECT doc_id, line_no, {BLAME_SQL} AS crate FROM lines)
    SELECT doc_id, arg_min(crate, line_no) FILTER (crate IS NOT NULL) AS crate FROM blamed GROUP BY doc_id"""


def _documents(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.col("text").alias("content"))


def _lines(spark: SparkSession, root: str) -> DataFrame:
    return number_lines(_documents(spark, root))


# Lines that start with T become comments, those that start with E follow an empty line.
LIST_SQL = lines_sql("replace(replace(text, chr(10) || 'T', chr(10) || '#T'), chr(10) || 'E', chr(10) || chr(10) || 'E')")
# One word becomes an error, in mixed case.
ERROR_SQL = lines_sql("replace(text, 'was', 'eRRor')")


@audit("comment_filter", f"WITH {LIST_SQL} SELECT * FROM lines WHERE line <> '' AND NOT starts_with(line, '#')")
def comment_filter(spark: SparkSession, root: str) -> DataFrame:
    commented = F.replace(F.col("content"), F.lit("\nT"), F.lit("\n#T"))
    content = F.replace(commented, F.lit("\nE"), F.lit("\n\nE"))
    return G.entries(_documents(spark, root).withColumn("content", content))


@audit("numbered_lines", f"WITH {LINES_SQL} SELECT * FROM lines")
def numbered_lines(spark: SparkSession, root: str) -> DataFrame:
    return _lines(spark, root)


@audit("first_blame", FIRST_BLAME_SQL)
def first_blame(spark: SparkSession, root: str) -> DataFrame:
    return G.first_blame_of_text(_documents(spark, root), WORD_PATTERNS)


@audit("first_blame_of_lines", FIRST_BLAME_SQL)
def first_blame_of_lines(spark: SparkSession, root: str) -> DataFrame:
    return G.first_blame(_lines(spark, root), ["doc_id"], WORD_PATTERNS)


def _ranked_sql(order: str, n: int, where: str = "true", lines: str = LINES_SQL) -> str:
    return f"""WITH {lines}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no {order}) AS r FROM lines WHERE {where})
    SELECT doc_id, line_no, line FROM ranked WHERE r <= {n}"""


@audit("head_lines", _ranked_sql("ASC", 20))
def head_lines(spark: SparkSession, root: str) -> DataFrame:
    return G.head_of_text(_documents(spark, root))


@audit("tail_lines", _ranked_sql("DESC", 20))
def tail_lines(spark: SparkSession, root: str) -> DataFrame:
    return G.tail_of_text(_documents(spark, root))


@audit("tail_of_line_table", _ranked_sql("DESC", 20))
def tail_of_line_table(spark: SparkSession, root: str) -> DataFrame:
    return G.tail_lines(_lines(spark, root), ["doc_id"])


@audit("error_lines", _ranked_sql("ASC", 8, "contains(lower(line), 'error')", ERROR_SQL))
def error_lines(spark: SparkSession, root: str) -> DataFrame:
    content = F.replace(F.col("content"), F.lit("was"), F.lit("eRRor"))
    return G.errors_of_text(_documents(spark, root).withColumn("content", content))


@audit(
    "error_lines_of_turns",
    """WITH turns AS (SELECT conv_id, turn AS line_no, replace(text, 'th', 'Error') AS line FROM conversations),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY line_no) AS r
      FROM turns WHERE contains(lower(line), 'error'))
    SELECT conv_id, line_no, line FROM ranked WHERE r <= 3""",
)
def error_lines_of_turns(spark: SparkSession, root: str) -> DataFrame:
    """A conversation is a log and a turn one of its lines."""
    line = F.replace(F.col("text"), F.lit("th"), F.lit("Error"))
    turns = table(spark, root, "conversations").select("conv_id", F.col("turn").alias("line_no"), line.alias("line"))
    return G.error_lines(turns, ["conv_id"], 3)


@audit(
    "gap_lines",
    f"""WITH {LINES_SQL} SELECT doc_id, line_no,
      regexp_replace('WARN [' || lang || ' fixups] ' || line, '^.*fixups\\] ', '  ') AS line
    FROM lines JOIN documents USING (doc_id)""",
)
def gap_lines(spark: SparkSession, root: str) -> DataFrame:
    texts = table(spark, root, "documents").select("doc_id", "lang", F.col("text").alias("content"))
    prefixed = F.concat(F.lit("WARN ["), "lang", F.lit(" fixups] "), "line")
    return G.gap_lines(number_lines(texts).withColumn("line", prefixed)).drop("lang")


@audit(
    "collection_members",
    "SELECT lang AS crate, source || '/' || doc_id AS path, sha256(text) AS content_hash FROM documents",
)
def collection_members(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select(
        F.col("lang").alias("crate"),
        F.concat("source", F.lit("/"), F.col("doc_id")).alias("path"),
        F.sha2("text", 256).alias("content_hash"),
    )
