"""The given tables in the roles of sweep labels, manifests, graphs and logs.

Every part is a target: its type is the package, its name and size are the
versioned name, its brand is the configuration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import strip_config

# The same label in both engines.
LABEL_SQL = "('//' || lower(p_type) || ':' || replace(p_name, ' ', '_') || '-' || p_size || '#' || p_brand)"
PLAIN_SQL = "('//' || lower(p_type) || ':' || replace(p_name, ' ', '_') || '-' || p_size)"
# Targets in the packages of the rigs a change can name.
RIG_LABEL_SQL = (
    "('fixups//third-party/conflict-rigs/' || lower(p_type) || ':' || replace(p_name, ' ', '_') || '-' || p_size)"
)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def balanced(df: DataFrame, *keys: str) -> DataFrame:
    """Spread narrow rows over all partitions before each becomes a text to read.

    Reading a text costs far more than moving a row, and a scan may have fewer
    splits than there are cores. A partition count of its own keeps adaptive
    execution from joining the partitions, which are small only in bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def crate_name() -> Column:
    return F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))


def versioned_name() -> Column:
    return F.concat(crate_name(), F.lit("-"), F.col("p_size"))


def label() -> Column:
    return F.concat(F.lit("//"), F.lower("p_type"), F.lit(":"), versioned_name(), F.lit("#"), F.col("p_brand"))


def rig_label() -> Column:
    return F.concat(F.lit("fixups//third-party/conflict-rigs/"), F.lower("p_type"), F.lit(":"), versioned_name())


def year_of(column: str) -> Column:
    return F.year(column).cast("string")


def labels_of(lines: DataFrame, parts: DataFrame, *extra: str) -> DataFrame:
    """Plain labels of the parts on the given line items.

    The line items are reduced to distinct parts before the join.
    """
    seen = lines.select("l_partkey", *extra).distinct()
    joined = seen.join(parts, seen["l_partkey"] == parts["p_partkey"])
    return joined.select(*extra, strip_config(label()).alias("label"))


def observed(spark: SparkSession, root: str) -> DataFrame:
    """Parts returned since 1998."""
    lines = table(spark, root, "lineitem").where(
        "l_returnflag = 'R' AND l_shipdate >= timestamp_ntz '1998-01-01 00:00:00'"
    )
    return labels_of(lines, table(spark, root, "part"))


def known(spark: SparkSession, root: str) -> DataFrame:
    """Parts returned before 1998."""
    lines = table(spark, root, "lineitem").where(
        "l_returnflag = 'R' AND l_shipdate < timestamp_ntz '1998-01-01 00:00:00'"
    )
    return labels_of(lines, table(spark, root, "part"))


def sightings(spark: SparkSession, root: str) -> DataFrame:
    """Both of the above in one pass: ``(label, seen, listed)`` per returned part.

    The line items are reduced to one row per part before the join.
    """
    since = F.col("l_shipdate") >= F.expr("timestamp_ntz '1998-01-01 00:00:00'")
    returned = (
        table(spark, root, "lineitem")
        .where("l_returnflag = 'R'")
        .groupBy("l_partkey")
        .agg(F.bool_or(since).alias("seen"), F.bool_or(~since).alias("listed"))
    )
    joined = returned.join(table(spark, root, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(strip_config(label()).alias("label"), "seen", "listed")


def _returned(comparison: str) -> str:
    return (
        f"SELECT DISTINCT {PLAIN_SQL} AS label FROM lineitem JOIN part ON l_partkey = p_partkey "
        f"WHERE l_returnflag = 'R' AND l_shipdate {comparison} TIMESTAMP '1998-01-01'"
    )


OBSERVED_SQL = f"observed AS ({_returned('>=')})"
KNOWN_SQL = f"known AS ({_returned('<')})"
