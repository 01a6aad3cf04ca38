"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases, these into longer ones, and so on until one is left. Where a phrase begins is decided by
deterministic coin tossing: a symbol is replaced by the place and value of the lowest bit in which it differs from the symbol before,
until few labels are left, and phrases begin at local maxima. That depends on a few symbols around only, and a phrase's
name is a hash of its symbols' names. So equal substrings get equal phrases and names inside, wherever they stand, and an edit changes
the names around it alone. A fingerprint keeps the smallest of the names of a dozen and a half bytes or more.

All texts of a batch are parsed at once, in flat arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .shared import ship, slices

NAMES = 64  # of a fingerprint, of 8 hex digits each
LEVEL = 3  # names of this level and above count: about 19 bytes of text and more
SLICE_BYTES = 1 << 20
BUCKET_BYTES, BUCKETS = 64 << 20, 1 << 16
BASE, ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
LAST = (1 << 63) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all of each; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def coin(before: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Twice the place of the lowest bit in which neighbours differ, and the own value of that bit."""
    differ = before ^ own
    place = np.bitwise_count((differ & (~differ + differ.dtype.type(1))) - differ.dtype.type(1))
    return (2 * place + ((own >> np.minimum(place, 63).astype(own.dtype)) & own.dtype.type(1)).astype(np.uint8)).astype(np.uint8)


_BYTE = np.arange(256, dtype=np.uint8)
BYTE_COINS = coin(np.repeat(_BYTE, 256), np.tile(_BYTE, 256))
LABEL_COINS = BYTE_COINS.reshape(256, 256)[:136, :136].ravel().copy()  # labels of 64-bit symbols are at most 129
BYTE_NAMES = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)


def labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Few different labels, by coins tossed until no fewer remain; ``first`` marks where texts begin."""
    own = np.zeros(len(symbols), np.uint8)
    if symbols.dtype == np.uint8:
        own[1:] = BYTE_COINS[symbols[:-1].astype(np.uint16) << 8 | symbols[1:]]
        rounds = 2
    else:
        own[1:] = coin(symbols[:-1], symbols[1:])
        rounds = 3
    own[first] = (symbols[first] & symbols.dtype.type(1)).astype(np.uint8)
    for _ in range(rounds):
        after = np.zeros(len(symbols), np.uint8)
        after[1:] = LABEL_COINS[own[:-1].astype(np.uint16) * np.uint16(136) + own[1:]]
        after[first] = own[first] & 1
        own = after
    return own


def parse_level(symbols: np.ndarray, starts: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the phrases, where texts begin among them, and the symbol each phrase begins with. No text is empty."""
    n = len(symbols)
    first = np.zeros(n, bool)
    first[starts] = True
    # Equal neighbours are one symbol with its number.
    run = first.copy()
    run[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(run)
    kinds = symbols[at] if len(at) < n else symbols
    first = first[at] if len(at) < n else first
    names = BYTE_NAMES[kinds] if kinds.dtype == np.uint8 else kinds.copy()
    if len(at) < n:
        times = np.diff(np.r_[at, n])
        several = np.flatnonzero(times > 1)
        names[several] = mixed(names[several] + times[several].astype(np.uint64) * ADD)
    own = labels(kinds, np.flatnonzero(first))
    cut = first.copy()
    cut[1:-1] |= (own[1:-1] > own[:-2]) & (own[1:-1] > own[2:]) & ~first[2:]
    begins = np.flatnonzero(cut)
    sizes = np.diff(np.r_[begins, len(kinds)])
    inside = np.arange(len(kinds)) - np.repeat(begins, sizes)
    powers = np.r_[np.uint64(1), np.full(int(sizes.max()), BASE, np.uint64)]
    np.multiply.accumulate(powers, out=powers)
    sums = np.add.reduceat(names * powers.take(inside), begins)
    return mixed(sums + sizes.astype(np.uint64) * ADD + np.uint64(level)), np.flatnonzero(first[begins]), at[begins]


def phrases(texts: list[bytes], placed: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]]:
    """Level by level: its number, and for each phrase the text's number, its first byte there if ``placed``, its name, and
    whether it is the whole text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    doc = np.flatnonzero(sizes)
    symbols = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[doc]
    offset, place = starts, np.arange(len(symbols)) if placed else None
    level = 0
    while len(doc):
        level += 1
        symbols, starts, at = parse_level(symbols, starts, level)
        count = np.diff(np.r_[starts, len(symbols)])
        alone = count == 1
        if placed:
            place = place[at]
        yield level, np.repeat(doc, count), place - np.repeat(offset, count) if placed else None, symbols, np.repeat(alone, count)
        if alone.any():
            stay = np.repeat(~alone, count)
            symbols, place = symbols[stay], place[stay] if placed else None
            doc, offset, count = doc[~alone], offset[~alone], count[~alone]
            starts = np.cumsum(count) - count


def smallest_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the smallest different names that count, ascending, one text after the other, and where each text's end."""
    doc, name = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for level, of, _, symbols, whole in phrases(texts, placed=False):
        counts = whole if level < LEVEL else np.ones(len(of), bool)
        doc.append(of[counts])
        name.append((symbols[counts] >> np.uint64(32)).astype(np.uint32))
    key = np.unique(np.concatenate(doc) << 32 | np.concatenate(name).astype(np.int64))
    of = key >> 32
    first = np.searchsorted(of, of)
    kept = np.arange(len(key)) - first < NAMES
    return (key[kept] & 0xFFFFFFFF).astype(np.uint32), np.searchsorted(of[kept], np.arange(len(texts)), side="right")


def likeness(names: tuple[np.ndarray, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of pairs of texts by their numbers: twice the names they share over the names of both, from 0 to 1.

    Estimated from the smallest names of both together, exact where both fingerprints hold all names; without any, texts are alike.
    """
    values, ends = names
    begins = np.r_[0, ends[:-1]]
    n = len(left)

    def side(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = ends[of] - begins[of]
        pair = np.repeat(np.arange(n), size)
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return pair << 32 | values[np.repeat(begins[of], size) + inside].astype(np.int64), size

    (a, a_size), (b, b_size) = side(left), side(right)
    key, times = np.unique(np.r_[a, b], return_counts=True)
    pair = key >> 32
    rank = np.arange(len(key)) - np.searchsorted(pair, pair)
    complete = (a_size < NAMES) & (b_size < NAMES)
    seen = (rank < NAMES) | complete[pair]
    union = np.bincount(pair[seen], minlength=n)
    shared = np.bincount(pair[seen & (times == 2)], minlength=n)
    return np.where(union == 0, 1.0, 2 * shared / np.maximum(union + shared, 1))


def digits(names: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """Each text's fingerprint: its smallest names, ascending, 8 hex digits each; empty for an empty text."""
    values, ends = names
    whole = values.astype(">u4").tobytes().hex()
    cut = np.r_[0, 8 * ends].tolist()
    return [whole[b:e] for b, e in zip(cut, cut[1:])]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fingerprint``, a string, of every row's whole text. No shuffle.

    A null text counts as empty and has an empty fingerprint; equal texts have equal ones. A column called ``fingerprint`` is replaced. A task
    holds a megabyte of texts, or one longer text and some thirty times its bytes.
    """
    ship(docs.sparkSession)
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() != "fingerprint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digits(smallest_names(texts)))], [*batch.schema.names, "fingerprint"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{ddl}, fingerprint string")


def document_phrases(docs: DataFrame, level: int = LEVEL) -> DataFrame:
    """``(doc_id, begin, end, name)``: all phrases of ``level`` with the bytes of the text they stand for; of a shorter text its whole."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            for k, doc, begin, name, whole in phrases(texts):
                if k > level:
                    break
                end = np.r_[begin[1:], 0]
                end[np.r_[doc[1:] != doc[:-1], True]] = sizes[doc[np.r_[doc[1:] != doc[:-1], True]]]
                some = pa.array(whole | (k == level))
                columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(begin), pa.array(end), pa.array(name.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "begin", "end", "name"]).filter(some)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, begin long, end long, name long")


ORDERED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def order_key() -> list[Column]:
    """By descending ``doc_id``, rows without one last; of one id by a hash of the text."""
    return [
        F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(LAST)).alias("down"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"),
    ]


def bucket_bounds(keys: DataFrame, n_buckets: int, n_rows: int, smallest: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """First keys of buckets of about equal bytes, ascending: of ``(down, hash, bytes)``, by a sample of 20 rows or so for each bucket."""
    share = min(1.0, 20 * n_buckets / max(1, n_rows))
    drawn = keys.where(F.pmod(F.xxhash64("down", "hash"), F.lit(1 << 32)) < int(share * (1 << 32))).toArrow()
    down, hashes = (drawn.column(c).to_numpy() for c in ("down", "hash"))
    order = np.lexsort((hashes, down))
    reach = np.cumsum(drawn.column("bytes").to_numpy()[order])
    at = np.searchsorted(reach, np.arange(1, n_buckets) * (reach[-1] / n_buckets)) if len(order) else order
    found = {smallest} | {(int(down[i]), int(hashes[i])) for i in order[np.unique(np.minimum(at, len(order) - 1))].tolist()}
    bounds = np.array(sorted(found), np.int64)
    return bounds[:, 0], bounds[:, 1]


def bucket_of(down: np.ndarray, hashes: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The last bucket that does not begin after each key."""
    low, high = (np.searchsorted(bounds[0], down, side=s) for s in ("left", "right"))
    bucket = high - 1
    for b in np.unique(low[low < high]).tolist():
        same = (low == b) & (low < high)
        bucket[same] = b + np.searchsorted(bounds[1][b : high[same][0]], hashes[same], side="right") - 1
    return bucket


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` its fingerprint, that of an edited text, and how much it is like that and like the next document's.

    The next document has the next smaller ``doc_id``; after the last comes the first. Rows without an id come
    last; rows of one id go by a hash of their texts, so repeated rows follow each other. The edited text has its last half (rounded
    down, in code points) replaced by as many code points of the next document, or all of it. A null text counts as empty; two
    empty texts are alike, an empty one and another are not; a single row is its own next one. Other columns
    than ``doc_id`` and ``text`` are not read; an empty table gives no rows.

    Rows are dealt once, into ranges of about equal bytes by a sample of their keys, and each range is read in order, a megabyte at a
    time. The first row of the next range goes along with each. Of these ranges there are 65,536 at most, so their first keys, which go to all
    tasks, have a bounded size.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *order_key())
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("long").alias("bytes")
    keys = stage(rows.select("down", "hash", size), "keys")
    n_rows, n_bytes, smallest = keys.agg(F.count("*"), F.sum("bytes"), F.min(F.struct("down", "hash"))).first()
    if not n_rows:
        return spark.createDataFrame([], ORDERED)
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // BUCKET_BYTES)
    bounds = bucket_bounds(keys, min(wanted, BUCKETS, n_rows), n_rows, tuple(smallest))
    n = len(bounds[0])
    sent = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def bucket(down: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(down.to_numpy(), hashes.to_numpy(), sent.value).astype(np.int32))

    kinds = "bucket int, down long, hash long"
    firsts = spark.createDataFrame(pa.table([pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, bounds)], ["bucket", "down", "hash"]).to_pandas(), kinds)
    # A range ends with the row the next one begins with.
    heads = rows.join(F.broadcast(firsts), ["down", "hash"]).groupBy("bucket").agg(F.first(F.struct("doc_id", "text", "down", "hash")).alias("row"))
    tails = heads.select(F.pmod(F.col("bucket") - 1, F.lit(n)).cast("int").alias("bucket"), F.lit(1).alias("tail"), "row.*")
    own = rows.select(bucket("down", "hash").alias("bucket"), F.lit(0).alias("tail"), "doc_id", "text", "down", "hash")
    ranged = own.unionByName(tails).repartitionById(n, "bucket").sortWithinPartitions("bucket", "tail", "down", "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row before, whose next one comes now
        for batch in slices(batches, "text", SLICE_BYTES):
            ids = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            tail = batch.column("tail").to_pylist()
            if held is not None:
                ids, texts, tail = [held[0], *ids], [held[1], *texts], [0, *tail]
            held = None if tail[-1] else (ids[-1], texts[-1])
            asked = [i for i in range(len(ids) - 1) if not tail[i]]
            edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in asked]
            changed = [t.encode() for t in edited]
            names = smallest_names([t.encode() for t in texts] + changed)
            prints = digits(names)
            at = np.array(asked, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in asked], pa.int64()),
                    pa.array([len(texts[i]) for i in asked], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
                    pa.array([prints[i] for i in asked], pa.string()),
                    pa.array(prints[len(texts) :], pa.string()),
                    pa.array(likeness(names, at, len(texts) + np.arange(len(asked)))),
                    pa.array(likeness(names, at, at + 1)),
                ],
                [f.split()[0] for f in ORDERED.split(", ")],
            )

    return ranged.select("doc_id", "text", "tail").mapInArrow(run, ORDERED)
