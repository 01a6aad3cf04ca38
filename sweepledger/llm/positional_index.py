"""Passages of a benchmark in training texts, by a distributed positional inverted index.

The index is cut by documents. Each row is one shard: its documents, its distinct terms, and for
each term the ascending list of its places (postings). Places run through the shard's documents
with a gap between two of them. It depends on the training texts alone, is stored once, and is
then searched for as many test phrases as wanted.

A search takes a phrase's terms from the rarest in the shard on: the rarest term's list,
moved back by the term's offset in the phrase, is intersected with the next one's, moved
likewise, until none is left or all terms agree. Whole lists of many phrases are intersected at once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .shared import fresh, row_places, ship, slices, without_places, words_of

SHARD_WORDS = 1 << 17
BLOCK_WORDS = 1 << 19
PIECE_WINDOWS = 1 << 12
CANDIDATES = 1 << 20

# With the type of the documents' ids.
INDEX = "shard long, doc_ids array<{}>, lengths array<int>, terms binary, ends binary, places binary"
MATCHES = "shard long, ordinal int, doc_id {}, n_words long, spans array<struct<begin:int,end:int>>, items array<string>"


def build_index(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per shard of about ``shard_words`` words; a longer document is a shard of its own.

    Words: ``[0-9a-z]`` and all beyond ASCII, A-Z lower-cased, of the whole text; a null text has
    none. Every row of ``docs`` is a document of its own, whatever its ``doc_id``, which may be of any type; other columns are not
    read. An empty table gives no shards. No shuffle; a task holds one shard at a time. Of a term's
    ``places`` each is stored as its distance from the one before.
    """

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        ids: list = []
        kind: pa.DataType | None = None
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        terms: dict[bytes, int] = defaultdict()
        terms.default_factory = terms.__len__
        held = 0

        def row() -> pa.RecordBatch:
            sizes = np.array(lengths, np.int32)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            gaps = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            order = np.argsort(flat, kind="stable")
            places = (np.arange(len(flat), dtype=np.int32) + gaps)[order]
            ends = np.cumsum(np.bincount(flat, minlength=len(terms)), dtype=np.int32)
            steps = np.diff(places, prepend=0).astype(np.int32)
            begins = np.r_[0, ends[:-1]] if len(ends) else ends
            steps[begins] = places[begins]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int64()),
                    pa.array([ids], pa.list_(kind)),
                    pa.array([lengths], pa.list_(pa.int32())),
                    pa.array([b" ".join(terms)], pa.binary()),
                    pa.array([ends.tobytes()], pa.binary()),
                    pa.array([steps.tobytes()], pa.binary()),
                ],
                ["shard", "doc_ids", "lengths", "terms", "ends", "places"],
            )

        for batch in slices(batches, "text"):
            kind = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                if held and held + len(words) > shard_words:
                    yield row()
                    shard, held = shard + 1, 0
                    ids.clear(), lengths.clear(), parts.clear(), terms.clear()
                parts.append(np.fromiter(map(terms.__getitem__, words), np.int32, len(words)))
                ids.append(doc_id)
                lengths.append(len(words))
                held += len(words) + 1
        if ids:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(run, INDEX.format(docs.schema["doc_id"].dataType.simpleString()))


class Phrases:
    """Distinct windows of a block of items, as term numbers, and the items that hold each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        holders: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, words in items:
            for i in range(max(1, len(words) - width + 1)) if words else ():
                holders[tuple(words[i : i + width])].add(item)
        self.terms = list({w for window in holders for w in window})
        number = {w: i for i, w in enumerate(self.terms)}
        self.names = sorted({item for items in holders.values() for item in items})
        name = {item: i for i, item in enumerate(self.names)}
        # By length of window: the windows' terms, and each window's items from ``starts`` on in ``items``.
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size in sorted({len(w) for w in holders}):
            some = [w for w in holders if len(w) == size]
            matrix = np.array([[number[t] for t in w] for w in some], np.int32)
            held = [sorted(name[i] for i in holders[w]) for w in some]
            starts = np.cumsum([0, *map(len, held)])
            self.groups.append((matrix, starts, np.array([i for h in held for i in h], np.int64)))


class Shard:
    """Postings of one row of the index, ready to be intersected."""

    def __init__(self, row: dict):
        self.doc_ids, self.lengths = row["doc_ids"], np.array(row["lengths"], np.int64)
        self.bases = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.ends = np.frombuffer(row["ends"], np.int32).astype(np.int64)
        self.begins = np.r_[0, self.ends[:-1]] if len(self.ends) else self.ends
        steps = np.frombuffer(row["places"], np.int32).astype(np.int64)
        reach = np.cumsum(steps)
        self.places = reach - np.repeat(reach[self.begins] - steps[self.begins], self.ends - self.begins)
        self.numbers = {t: i for i, t in enumerate(row["terms"].split(b" "))} if row["terms"] else {}
        # All lists in one ascending array: places of one term lie in a range of its own.
        self.margin = int(self.lengths.sum()) + len(self.lengths) + 1
        term = np.repeat(np.arange(len(self.ends)), self.ends - self.begins)
        self.keys = term * (3 * self.margin) + self.margin + self.places

    def key(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        return term * (3 * self.margin) + self.margin + np.clip(place, -self.margin, 2 * self.margin - 1)

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = self.key(term, place)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key

    def within(self, term: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often the terms stand at places from ``begin`` to before ``end``."""
        return np.searchsorted(self.keys, self.key(term, end)) - np.searchsorted(self.keys, self.key(term, begin))

    def rarest_first(self, phrases: Phrases, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Of the windows whose terms all occur here, some at a time: their numbers, their terms and these
        terms' offsets from the rarest on, and the rarest term's places with the window of each."""
        own = np.fromiter((self.numbers.get(t, -1) for t in phrases.terms), np.int64, len(phrases.terms))
        terms = own[matrix]
        live = np.flatnonzero((terms >= 0).all(axis=1))
        if not len(live):
            return
        terms = terms[live]
        counts = (self.ends - self.begins)[terms]
        offsets = np.argsort(counts, axis=1, kind="stable")
        terms = np.take_along_axis(terms, offsets, axis=1)
        first = np.take_along_axis(counts, offsets, axis=1)[:, 0]
        group = np.cumsum(first) // CANDIDATES
        for some in np.split(np.arange(len(live)), np.flatnonzero(np.diff(group)) + 1):
            n = first[some]
            window = np.repeat(some, n)
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield live, terms, offsets, window, self.places[self.begins[terms[window, 0]] + inside]

    def exact(self, phrases: Phrases, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that occur, with begin and end of each occurrence."""
        found = [np.zeros((0, 2), np.int64)]
        for live, terms, offsets, window, place in self.rarest_first(phrases, matrix):
            begin = place - offsets[window, 0]
            for k in range(1, matrix.shape[1]):
                agree = self.holds(terms[window, k], begin + offsets[window, k])
                window, begin = window[agree], begin[agree]
            found.append(np.stack([live[window], begin], axis=1))
        window, begin = np.concatenate(found).T
        return window, begin, begin + matrix.shape[1]

    def near(self, phrases: Phrases, matrix: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose terms all stand, in any order, within their number plus ``slop`` words of one document."""
        span = matrix.shape[1] + slop
        found = [np.zeros((0, 3), np.int64)]
        for live, terms, _, window, place in self.rarest_first(phrases, matrix):
            needed = (terms[:, :, None] == terms[:, None, :]).sum(axis=2)
            doc = np.searchsorted(self.bases, place, side="right") - 1
            for shift in range(span):
                w, begin = window, np.maximum(place - shift, self.bases[doc])
                end = np.minimum(place - shift + span, self.bases[doc] + self.lengths[doc])
                for k in range(matrix.shape[1]):
                    agree = self.within(terms[w, k], begin, end) >= needed[w, k]
                    w, begin, end = w[agree], begin[agree], end[agree]
                found.append(np.stack([live[w], begin, end], axis=1))
        return tuple(np.unique(np.concatenate(found), axis=0).T)

    def matches(self, phrases: Phrases, slop: int | None) -> tuple[list[list[dict]], list[list[str]]]:
        """Per document: the spans hit, joined where they touch, and the items found."""
        edge = np.zeros(self.margin + 1, np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        for matrix, starts, items in phrases.groups:
            if not len(self.keys):
                break
            window, begin, end = self.exact(phrases, matrix) if slop is None else self.near(phrases, matrix, slop)
            np.add.at(edge, begin, 1)
            np.add.at(edge, end, -1)
            doc = np.searchsorted(self.bases, begin, side="right") - 1
            doc, window = np.unique(np.stack([doc, window], axis=1), axis=0).T
            n = starts[window + 1] - starts[window]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            pairs.append(np.stack([np.repeat(doc, n), items[np.repeat(starts[window], n) + inside]], axis=1))
        change = np.diff(np.r_[0, np.cumsum(edge) > 0].astype(np.int8))
        begins, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        spans: list[list[dict]] = [[] for _ in self.doc_ids]
        names: list[list[str]] = [[] for _ in self.doc_ids]
        owner = np.searchsorted(self.bases, begins, side="right") - 1
        for d, b, e in zip(owner.tolist(), begins.tolist(), ends.tolist()):
            base = int(self.bases[d])
            spans[d].append({"begin": b - base, "end": e - base})
        for d, i in np.unique(np.concatenate(pairs), axis=0).tolist():
            names[d].append(phrases.names[i])
        return spans, names


def item_pieces(items: DataFrame, width: int) -> DataFrame:
    """``(item, words, n_words)``: the items ``(item_id, text)``, as pieces of ``PIECE_WINDOWS`` windows of ``width`` consecutive words
    at most, which overlap, so that each window is in one of them. A shorter item is one window, one without words gives no row."""
    ship(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                for i in range(0, max(1, len(words) - width + 1) if words else 0, PIECE_WINDOWS):
                    piece = words[i : i + PIECE_WINDOWS + width - 1]
                    rows.append({"item": item, "words": b" ".join(piece), "n_words": len(piece)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("item", pa.string()), ("words", pa.binary()), ("n_words", pa.int64())]))

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return named.mapInArrow(run, "item string, words binary, n_words long")


def phrase_blocks(items: DataFrame, width: int, block_words: int = BLOCK_WORDS) -> Iterator[Phrases]:
    """The windows of the items, block by block, each of about ``block_words`` words; one block, if need be an empty one, at least.

    The pieces are written once and dealt to blocks by a hash; the driver holds one block at a time.
    """
    pieces = stage(item_pieces(items, width), "item-pieces")
    n = max(1, -(-pieces.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0] // block_words))
    for block in range(n):
        rows = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == block).select("item", "words").toArrow()
        yield Phrases([(i, w.split(b" ")) for i, w in zip(rows.column("item").to_pylist(), rows.column("words").to_pylist())], width)


def search(index: DataFrame, phrases: Phrases, slop: int | None = None) -> DataFrame:
    """Every document of the index with its matches (see ``MATCHES``). The block of phrases, of
    bounded size, goes to all tasks. No shuffle."""
    ship(index.sparkSession)
    sent = index.sparkSession.sparkContext.broadcast(phrases)
    return index.mapInArrow(_matcher(sent, slop), MATCHES.format(index.schema["doc_ids"].dataType.elementType.simpleString()))


def _matcher(sent, slop: int | None):
    spans_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = batch.column("doc_ids").slice(i, 1).flatten()
                shard = Shard(row)
                spans, names = shard.matches(sent.value, slop)
                n = len(spans)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * n, pa.int64()),
                        pa.array(range(n), pa.int32()),
                        ids,
                        pa.array(shard.lengths),
                        pa.array(spans, spans_type),
                        pa.array(names, pa.list_(pa.string())),
                    ],
                    ["shard", "ordinal", "doc_id", "n_words", "spans", "items"],
                )

    return run


def find_passages(
    docs: DataFrame, items: DataFrame, width: int = 10, slop: int | None = None, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``spans`` and ``items``.

    ``spans`` are the stretches of the document's words inside occurrences of windows of ``width`` item words, in
    order and disjoint; ``items`` the ids (as text) of the items with such a window, each once. With a ``slop``,
    a window occurs where its words stand in any order within ``slop`` words more than their own number.

    A null text has no words and is not hit; an item without an id has an empty one; repeated items
    and documents are fine; without items, or with empty tables, nothing is hit. The index is written to
    the shared checkpoint folder and searched once per block of items, however
    many there are. Of several blocks each one's matches are written before the next is made, and only then are a
    document's matches brought together by a shuffle.
    """
    index = stage(build_index(docs), "postings", compression="zstd")
    spark, whole, parts = docs.sparkSession, None, []
    kind = MATCHES.format(index.schema["doc_ids"].dataType.elementType.simpleString())
    for phrases in phrase_blocks(items, width, block_words):
        if whole is not None:  # a second block: from here on matches are tables
            parts.append(stage(whole if not parts else whole.where(F.size("spans") > 0), "matches"))
            sent.destroy()
        sent = spark.sparkContext.broadcast(phrases)
        whole = index.mapInArrow(_matcher(sent, slop), kind)
    if not parts:
        return whole.select("doc_id", "n_words", "spans", "items")
    every = whole.where(F.size("spans") > 0)
    for more in parts:
        every = every.unionByName(more)
    return (
        every.groupBy("shard", "ordinal")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
        .select("doc_id", "n_words", joined_spans(F.col("spans")).alias("spans"), "items")
    )


def keep_clean(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of an item.

    Rows are told apart by their places (see ``row_places``), so repeated ids do not matter.
    """
    (place,) = fresh(docs, "place")
    placed = row_places(docs, place)
    found = find_passages(placed.select(F.col(place).alias("doc_id"), "text"), items, width)
    return without_places(placed, found.where(F.size("spans") > 0).withColumnRenamed("doc_id", place), place)


def joined_spans(spans: Column) -> Column:
    """Ascending spans made disjoint."""

    def add(done: Column, span: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end"))
        touches = (F.size(done) > 0) & (last["end"] >= span["begin"])
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(
            F.concat(done, F.array(span))
        )

    return F.aggregate(spans, F.array().cast("array<struct<begin:int,end:int>>"), add)


def passage_digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
