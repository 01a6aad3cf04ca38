"""URL rules by a blocked Bloom filter and an exact hash join.

A rule is a host with a path prefix; a listed URL is a rule with its whole path. All keys
that could list a URL (its host and parent hosts, with the prefixes of its path that
have the length of some rule's) are looked up in a blocked Bloom filter: one block of
eight 64-bit words per key, one bit in each word. Possible hits go on to an exact
join with the rules, which removes the false positives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

WORDS = 8
A_Z, A_Z_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """From ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*", 0)
    return F.coalesce(F.translate(host, A_Z, A_Z_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(keys: list[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(blocks))


def _bits(keys: list[str]) -> list[Column]:
    """One bit number (0 to 63) for each word of a block."""
    h = F.xxhash64(*keys, F.lit(1))
    return [F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int") for i in range(WORDS)]


def blocked_bloom(listed: DataFrame, keys: list[str], blocks: int) -> DataFrame:
    """The filter's blocks that hold a key: ``(block, w0 .. w7)``, ``blocks`` rows at most."""
    names = [f"w{i}" for i in range(WORDS)]
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias(n) for bit, n in zip(_bits(keys), names)]
    return (
        listed.select(_block(keys, blocks).alias("block"), *masks).groupBy("block").agg(*[F.bit_or(n).alias(n) for n in names])
    )


def may_hold(probes: DataFrame, keys: list[str], bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key may be in the filter: all that are, and a few others.

    The filter is broadcast; ``blocks`` bounds its size at 72 bytes a block.
    """
    hit = reduce(
        lambda a, b: a & b,
        [F.call_function("shiftright", F.col(f"w{i}"), bit).bitwiseAND(1) == 1 for i, bit in enumerate(_bits(keys))],
    )
    probed = probes.withColumn("block", _block(keys, blocks))
    return probed.join(F.broadcast(bloom), "block").where(hit).select(*probes.columns)


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", bits_per_key: int = 16, max_blocks: int = 1 << 17
) -> DataFrame:
    """All rows and columns of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules``: ``(host, path, verdict)``. A rule fits its host and all hosts below it, if
    the URL's path starts with the rule's. The longest rule (host and path together) wins,
    then the one with the longer host; of equal rules with both verdicts, ``block`` wins.
    Unlisted URLs get a null ``rule`` and ``default``. Rules with a null part are none; a null URL,
    or one without ``://``, has an empty host and path. Repeated rows stay; input columns
    of the four names are replaced.

    The filter has ``max_blocks`` blocks at most (9 MB), so broadcasting it is safe for any
    list; a longer list only has more false positives, which the exact join removes.
    Work goes over distinct (host, path) pairs; the joins with the rules and back to the pages are equi-joins
    that Spark broadcasts or splits by measured sizes. On the driver: the distinct pairs of
    (labels in a rule's host, length of its path), which address lengths bound.
    """
    added = ["host", "path", "rule", "verdict"]
    pages = pages.select(*[c for c in pages.columns if c.lower() not in added])
    listed = (
        rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
        .dropna()
        .groupBy("rule_host", "rule_path")
        .agg(F.min(F.when(F.col("verdict") == "block", 0).otherwise(1)).alias("mild"))
    )
    key = ["rule_host", "rule_path"]
    shapes = [
        tuple(r)
        for r in listed.select(F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("length"))
        .distinct()
        .collect()
    ]
    blocks = min(max_blocks, max(1, -(-listed.count() * bits_per_key // (64 * WORDS))))
    addressed = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    distinct = addressed.select("host", "path").distinct()
    probes = [
        F.when(
            (F.size(F.split("host", r"\.")) >= labels) & (F.length("path") >= length),
            F.struct(F.substring_index("host", ".", -labels).alias("rule_host"), F.substring("path", 1, length).alias("rule_path")),
        )
        for labels, length in sorted(shapes)
    ]
    if not probes:
        return addressed.select(*pages.columns, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = distinct.select("host", "path", F.inline(F.array_compact(F.array(*probes))))
    possible = may_hold(keys, key, blocked_bloom(listed, key, blocks), blocks)
    rule = F.concat("rule_host", "rule_path")
    best = (
        possible.join(listed, key)
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("wide"), rule.alias("rule"), "mild")).alias("best"))
        .select(
            "host", "path", F.col("best.rule").alias("rule"), F.when(F.col("best.mild") == 0, "block").otherwise("allow").alias("verdict")
        )
    )
    (given,) = fresh(pages, "given")
    joined = addressed.join(best.withColumnRenamed("verdict", given), ["host", "path"], "left")
    return joined.select(*pages.columns, "host", "path", "rule", F.coalesce(given, F.lit(default)).alias("verdict"))
