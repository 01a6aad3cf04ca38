"""Connected components of a graph of links, in rounds of stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def _staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _delete(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = links.union(links.select("b", "a"))
    smallest = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.join(smallest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(smallest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(smallest.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node with a link to another; ``root`` is the component's smallest node.

    ``links``: ``(a, b)``, both numbers; direction, repeats and links to oneself do not matter, null ends
    are no links. Without links the result is empty. The rounds end when nothing changes; their number
    grows with the logarithm of the longest path. Each round is written to the shared checkpoint folder and the one before it
    deleted, so a lost executor costs one round's work. The driver sees counts only.
    """
    links = links.toDF("a", "b").where("a != b")
    now, path = _staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if new == mark or not new[0]:
            break
        mark = new
        after, next_path = _staged(_small_star(_large_star(now)), "links")
        _delete(now, path)
        now, path = after, next_path
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select("b", F.col("b").alias("root")).distinct()
    )
