"""Uniform shuffle into shards of exact sizes, by a communication matrix. [native]

How many rows go from each source partition to each shard is drawn first: with the
margins given (rows per source, rows per shard), the counts of a uniform permutation follow
a multivariate hypergeometric law. Each source then permutes its rows locally and cuts them
by its line of the matrix; after the one exchange each shard permutes again. Shard
sizes therefore differ by one at most, whatever the texts or keys are.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .shared import fresh

# monotonically_increasing_id: the row's place in its partition in the low bits, the partition above.
PLACE_BITS = 33
# numpy draws hypergeometric counts of populations below this.
NUMPY_POPULATION = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows taken from ``good + bad`` are good."""
    if good < NUMPY_POPULATION and bad < NUMPY_POPULATION:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    # Inversion outwards from the mode: a few standard deviations of steps.
    at_mode = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    left = rng.random() - at_mode
    down, up, p_down, p_up = mode, mode, at_mode, at_mode
    while left > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if max(p_up, p_down) < 1e-300:
            break
    return mode


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows from each source (line) to each shard (column); lines add up to ``counts``,
    columns to shard sizes that are at most one apart."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = np.zeros((len(counts), shards), np.int64)
    for line, count in zip(matrix, counts):
        left, rest = count, sum(room)
        for j in range(shards):
            if not left:
                break
            rest -= room[j]
            line[j] = hypergeometric(rng, room[j], rest, left) if rest else left
            left -= int(line[j])
            room[j] -= int(line[j])
    return matrix


def shuffle_to_shards(
    docs: DataFrame, shards: int = 8, seed: int = 20, max_sources: int = 16_384, buckets_per_shard: int = 1024
) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` and ``slot``, its gapless place in the shard.

    ``docs`` is read once: each source permutes its rows locally, and they are written with source, place and
    rank to the shared folder. The matrix, the slot offsets and the exchange all read that table, so
    they agree on the sources, whatever partitions it is read in, and any frame will do.

    Bounds: the matrix has one line per source partition, and partitions beyond ``max_sources``
    are read together; the table of slot offsets has ``shards * buckets_per_shard`` rows.
    Both are broadcast, at these sizes at most. A shard's order is by a random key
    whose top bits are its bucket, so that no task holds a whole shard.

    Nulls, repeated rows and equal texts are rows like any other. An empty table gives no rows. Input
    columns called ``shard`` or ``slot`` are replaced.
    """
    if buckets_per_shard & (buckets_per_shard - 1) or buckets_per_shard < 2:
        raise ValueError("buckets_per_shard must be a power of two, at least 2")
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot").coalesce(max_sources)
    kept = docs.columns
    place, source, rank, bounds, key, bucket, base, shard, slot = fresh(
        docs, "place", "source", "rank", "bounds", "key", "bucket", "base", "shard", "slot"
    )
    # Each source permuted locally; no exchange.
    permuted = docs.withColumn(place, F.monotonically_increasing_id()).sortWithinPartitions(F.xxhash64(F.lit(seed), F.col(place)))
    ranked = permuted.withColumn(rank, F.monotonically_increasing_id()).select(
        *kept,
        place,
        F.shiftright(rank, PLACE_BITS).alias(source),
        F.col(rank).bitwiseAND((1 << PLACE_BITS) - 1).alias(rank),
    )
    ranked = stage(ranked, "sources")
    counts = sorted((r[0], r[1]) for r in ranked.groupBy(source).count().collect())
    matrix = communication_matrix([n for _, n in counts], shards, seed).cumsum(axis=1)
    lines = spark.createDataFrame(
        [(int(p), [int(x) for x in line]) for (p, _), line in zip(counts, matrix)], f"{source} bigint, {bounds} array<bigint>"
    )

    def dealt(columns: list[str]) -> DataFrame:
        """Each source cut into the shards' shares; no exchange."""
        target = F.size(F.filter(bounds, lambda b: b <= F.col(rank)))
        keyed = ranked.join(F.broadcast(lines), source).select(
            *columns, place, target.alias(shard), F.xxhash64(F.lit(seed + 1), F.col(place)).alias(key)
        )
        bits = buckets_per_shard.bit_length() - 1
        return keyed.withColumn(bucket, F.shiftrightunsigned(key, 64 - bits))

    sizes = dealt([]).groupBy(shard, bucket).count()
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(shard, bucket, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(base))
    again = F.row_number().over(Window.partitionBy(shard, bucket).orderBy(key, place))
    exchanged = dealt(kept).withColumn(rank, again)
    return exchanged.join(F.broadcast(offsets), [shard, bucket]).select(
        *kept, F.col(shard).alias("shard"), (F.col(base) + F.col(rank) - 1).alias("slot")
    )


def shard_digest(sharded: DataFrame) -> DataFrame:
    """Per document: its size, text checksum, shard and slot. A null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return sharded.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
