"""Near-duplicate groups: SimHash fingerprints, linked by multi-index hashing.

A fingerprint is kept in one table per segment of its bits. Two fingerprints that differ in ``r`` bits at most agree, in
one of the segments, up to ``r // segments`` bits; so every fingerprint enumerates the small
Hamming ball of each of its segments, fetches the table's entries under these
values and verifies complete distances.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .components import components
from .shared import LOWER_BYTES, fresh, row_places, ship, slices, utf8, without_places

BITS = 64
SEED = 42
# For each byte its bits, one to a byte of a 64-bit word: sums of up to 255 of them stay apart.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0].copy()


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words (A-Z lower-cased, split at ASCII white space), repeats included;
    of the whole sequence if it is shorter, of none if there are no words."""
    import xxhash

    words = [] if text is None else utf8(text).translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    n = max(1, len(words) - width + 1)
    cut = zip(begins[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[b:e], SEED) for b, e in cut), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Each bit that is set in over half of the hashes; zero without any."""
    counts = np.zeros(BITS, np.int64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for start in range(0, len(octets), 255 * 4096):
        some = octets[start : start + 255 * 4096]
        cuts = np.arange(0, len(some), 255)
        for k in range(8):
            sums = np.add.reduceat(LANES[some[:, k]], cuts)
            counts[8 * k : 8 * k + 8] += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = 2 * counts > len(hashes)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, width: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fingerprint`` of every row's whole text, as a signed 64-bit number. No shuffle.

    A text without words, or null, has fingerprint zero.
    """
    ship(docs.sparkSession)
    read = docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [majority(shingle_hashes(t, width)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], [*keep, "fingerprint"])

    kinds = dict(read.dtypes)
    return read.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", fingerprint long")


def ball(width: int, radius: int) -> list[int]:
    """All patterns of up to ``radius`` set bits of ``width``; the number at distance up to ``radius`` of x is x ^ pattern."""
    from itertools import combinations

    return [sum(1 << i for i in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]


def segment_table(prints: DataFrame, segments: int) -> DataFrame:
    """``(segment, part, fingerprint)``: each fingerprint under each of its segments' values."""
    width = BITS // segments
    parts = [
        F.struct(F.lit(i).alias("segment"), F.shiftrightunsigned("fingerprint", i * width).bitwiseAND((1 << width) - 1).alias("part"))
        for i in range(segments)
    ]
    return prints.select(F.inline(F.array(*parts)), "fingerprint")


def links_within(prints: DataFrame, distance: int = 3, segments: int = 2) -> DataFrame:
    """``(a, b)``: all pairs ``a < b`` of the distinct ``fingerprint``s that differ in ``distance`` bits at most.

    If all segments but the first ``distance % segments + 1`` differed in ``distance // segments`` bits or more, and these
    in one more each, the whole would differ in over ``distance`` bits; the balls have these radii.
    The distance is verified in the join, so that only links leave it.
    """
    if segments < 2 or BITS % segments or not 0 <= distance < BITS:
        raise ValueError("segments must be two or more and divide 64, distance be below 64")
    width, (radius, rest) = BITS // segments, divmod(distance, segments)
    table = segment_table(prints, segments)
    wide, small = ball(width, radius), ball(width, radius - 1) if radius else []
    masks = lambda patterns: F.array(*map(F.lit, patterns)).cast("array<bigint>")
    probes = table.select(
        "segment",
        "part",
        F.col("fingerprint").alias("probe"),
        F.explode(F.when(F.col("segment") <= rest, masks(wide)).otherwise(masks(small))).alias("pattern"),
    ).select("segment", F.col("part").bitwiseXOR(F.col("pattern")).alias("part"), "probe")
    near = F.bit_count(F.col("probe").bitwiseXOR(F.col("fingerprint"))) <= distance
    # Probes are many times the fingerprints, which estimates of their size do not see: they are never to be broadcast.
    met = probes.hint("merge").join(table, ["segment", "part"]).where((F.col("probe") < F.col("fingerprint")) & near)
    return met.select(F.col("probe").alias("a"), F.col("fingerprint").alias("b")).distinct()


def _groups(prints: DataFrame, first: Column, distance: int, segments: int) -> DataFrame:
    """``(fingerprint, first)``: for each distinct fingerprint the smallest ``first`` of all rows in its group."""
    distinct = prints.groupBy("fingerprint").agg(F.min(first).alias("first"))
    roots = components(links_within(distinct.select("fingerprint"), distance, segments))
    rooted = distinct.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fingerprint", "root").join(smallest, "root").select("fingerprint", "first")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3, segments: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row of ``docs``.

    ``fingerprint``: 16 hex digits. ``component_id``: the smallest ``doc_id`` that can be reached over
    fingerprints ``distance`` bits apart at most, null if all are null. Texts without words
    (null ones too) have fingerprint zero and are linked like any other. Repeated rows stay. Other columns are not read; an
    empty table gives no rows.

    Equal fingerprints are one entry from the start, so copies, however many, are linked without pairs;
    they meet again in the last join only, which Spark can split.
    """
    prints = stage(fingerprints(docs, width), "fingerprints")
    found = _groups(prints, F.col("doc_id"), distance, segments)
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return prints.join(found, "fingerprint").select("doc_id", digits.alias("fingerprint"), F.col("first").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 3, distance: int = 3, segments: int = 2) -> DataFrame:
    """The rows of ``docs`` less all but one of each group of near-duplicates, with all their columns.

    The row with the group's smallest ``doc_id`` stays (the first read of several with it; null ids come last).
    Rows are told apart by their places (see ``row_places``).
    """
    (place,) = fresh(docs, "place")
    placed = row_places(docs, place)
    prints = stage(fingerprints(placed, width, ("doc_id", place)), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(place).alias("at"))
    found = _groups(prints, order, distance, segments)
    others = prints.join(found, "fingerprint").where(F.col(place) != F.col("first.at"))
    return without_places(placed, others, place)
