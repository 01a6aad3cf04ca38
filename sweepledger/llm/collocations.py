"""Phrase collocations, counted in stripes: each prefix keys an associative counter of the words that follow it.

Stripes of one word more are made from those before. A task cuts its texts into blocks of numbered words once; for each
length it makes, per block and prefix, one stripe of next words and counts, and stripes of the
same prefix are merged elementwise. A block sends its stripes in a bounded number of bundles, by a hash of the prefix, so the rows sent grow
with the blocks, not with the prefixes that become frequent as texts are added. A phrase can only reach the wanted frequency if what is left
without its first and without its last word does, so longer stripes are made of such
words only. Which phrases do is told to the tasks by a bitmap of fixed size, addressed by a hash: it never
leaves a frequent phrase out, and what it lets through by chance falls short when stripes are merged.

From the merged stripes come a phrase's frequency (an entry), that of its parts (entries of shorter
prefixes), the words of a language (all entries of the empty prefix) and the most frequent extensions (the largest entry of a
stripe to the right, the largest of all stripes with the same later words to the left).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_stage, stage, stage_at
from .shared import ship, slices

BLOCK_WORDS = 1 << 20
# Bundles of stripes, by a hash of the prefix. A stripe is cut over several of them, by a hash of the next word: over so many that of a
# prefix that makes up a thousandth of all words or more, over all of them that of the empty prefix.
PARTS, HOT_SHARE, HOT_PARTS = 1024, 1000, 64
MERGE_BYTES = 4 << 20  # of next words, in a batch that is merged
BITS = 26  # the bitmap has 2 ** BITS bits: 8 MB
# A-Z lower-cased; the ends of pieces become line feeds, tabs spaces.
PIECES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else 0x0A if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 0x09 else c for c in range(256)
)
FACTOR, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BLOCK = "lang string, words binary, ids binary"
# A bundle: prefixes, a line feed between two, how many next words each has, those with a line feed between two, and
# their counts; numbers are 64-bit integers.
STRIPE = "lang string, part int, prefixes string, sizes binary, nexts string, counts binary"
STRIPE_TYPE = pa.schema(
    [
        ("lang", pa.string()),
        ("part", pa.int32()),
        ("prefixes", pa.string()),
        ("sizes", pa.binary()),
        ("nexts", pa.string()),
        ("counts", pa.binary()),
    ]
)
ENTRY = "lang string, prefix string, next string, n long"


def word_blocks(docs: DataFrame, unknown: str = "und", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of about ``block_words`` words of one ``lang``: the distinct ``words`` and the ``ids`` of all in order, -1 between pieces.

    Pieces end at ``[.,;:!?]``, line feeds to carriage returns and texts' ends; words are what lies between spaces and tabs in them. A
    null lang is ``unknown``, a null text has no words. No shuffle; a task holds a few blocks, or one longer text.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def block(lang: str) -> pa.RecordBatch:
            known, parts = held.pop(lang)
            sizes.pop(lang)
            words = b"\n".join(list(known)[2:])
            row = [pa.array([lang]), pa.array([words], pa.binary()), pa.array([np.concatenate(parts).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["lang", "words", "ids"])

        for batch in slices(batches, "text"):
            langs = batch.column("lang").to_pylist()
            for lang, text in zip(langs, batch.column("text").cast(pa.binary()).to_pylist()):
                if not text:
                    continue
                lang = unknown if lang is None else lang
                if lang not in held:
                    held[lang], sizes[lang] = ({b"": 0, b"\n": 1}, []), 0
                known, parts = held[lang]
                tokens = text.translate(PIECES).replace(b"\n", b" \n ").split(b" ")
                tokens.append(b"\n")
                for word in set(tokens).difference(known):
                    known[word] = len(known)
                ids = np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens))
                parts.append(np.maximum(ids[ids > 0] - 2, -1))
                sizes[lang] += len(parts[-1])
                if sizes[lang] >= block_words:
                    yield block(lang)
                elif sum(sizes.values()) >= 4 * block_words:
                    yield from map(block, list(held))
        yield from map(block, list(held))

    return docs.select("lang", "text").mapInArrow(run, BLOCK)


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def longer_hash(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of phrases with a word more; wraps."""
    return (phrase * FACTOR) ^ (word + (phrase >> np.uint64(29)))


def bit_of(phrase: np.ndarray) -> np.ndarray:
    return ((phrase * SPREAD) >> np.uint64(64 - BITS)).astype(np.int64)


def _positions(ids: np.ndarray, hashes: np.ndarray, width: int, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases of ``width`` words begin both of whose parts of a word less may be frequent, and the hash of the first part."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = ids >= 0
    each = hashes[ids]
    whole, part = inside.copy(), each
    for k in range(1, width - 1):
        whole = whole[:-1] & inside[k:]
        part = longer_hash(part[:-1], each[k:])
    bit = bit_of(part)
    good = whole & ((bitmap[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
    at = np.flatnonzero(good[:n] & good[1 : n + 1])
    return at, part[at]


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the row before in one of the ``keys``."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def packed(lang: pa.Array, part: np.ndarray, bundle: np.ndarray, prefix: np.ndarray, known: pa.Array, nexts: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """Bundles from entries in order: of each the number of its ``bundle``, of its prefix among the ``known``, its next word and count."""

    def joined(ends: np.ndarray, words: pa.Array) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words), "\n")

    def numbers(ends: np.ndarray, values: np.ndarray) -> pa.Array:
        raw = pa.py_buffer(values.astype(np.int64).tobytes())
        return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((8 * ends).astype(np.int32).tobytes()), raw])

    stripe = starts_of(bundle, prefix)
    first = starts_of(bundle)
    ends, stripe_ends = np.r_[first, len(counts)], np.r_[np.searchsorted(stripe, first), len(stripe)]
    prefixes = joined(stripe_ends, known.take(pa.array(prefix[stripe])))
    sizes = numbers(stripe_ends, np.diff(np.r_[stripe, len(counts)]))
    columns = [lang, pa.array(part.astype(np.int32)), prefixes, sizes, joined(ends, nexts), numbers(ends, counts)]
    return pa.RecordBatch.from_arrays(columns, schema=STRIPE_TYPE)


def block_stripes(lang: str, words: list[bytes], ids: np.ndarray, width: int, bitmap: np.ndarray | None, hot: set[str]) -> pa.RecordBatch:
    """The stripes of a block's phrases of ``width`` words, the last of which is the next word, in bundles; those of ``hot`` prefixes cut."""
    names = pa.array(words, pa.binary()).cast(pa.string())
    hashes = word_hashes(lang, words)
    if width == 1:
        count = np.bincount(ids[ids >= 0], minlength=len(words))
        following = np.arange(len(words))
        prefix, known, part = np.zeros(len(words), np.int64), pa.array([""]), hashes % np.uint64(PARTS)
    else:
        at, prefix_hash = _positions(ids, np.r_[hashes, np.uint64(0)], width, bitmap)
        if width == 2:
            prefix, known, of = ids[at].astype(np.int64), names, hashes
        else:
            # Numbers of the prefixes; two with one hash stay apart, as their words are compared.
            order = np.argsort(prefix_hash, kind="stable")
            sorted_at = at[order]
            new = np.r_[True, np.diff(prefix_hash[order]) != 0] if len(at) else np.zeros(0, bool)
            for k in range(width - 1):
                new[1:] |= ids[sorted_at[1:] + k] != ids[sorted_at[:-1] + k]
            prefix = np.zeros(len(at), np.int64)
            prefix[order] = np.cumsum(new) - 1
            known = pc.binary_join_element_wise(*[names.take(pa.array(ids[sorted_at[new] + k])) for k in range(width - 1)], " ")
            of = prefix_hash[order][new]
        keys = np.sort(prefix << 32 | ids[at + width - 1].astype(np.int64))
        starts = starts_of(keys)
        count = np.diff(np.r_[starts, len(keys)])
        prefix, following = keys[starts] >> 32, keys[starts] & 0xFFFFFFFF
        is_hot = pc.is_in(known, pa.array(sorted(hot), pa.string())).to_numpy(zero_copy_only=False)
        cut = np.where(is_hot[prefix], hashes[following] % np.uint64(HOT_PARTS), np.uint64(0))
        part = ((of[prefix] * SPREAD >> np.uint64(32)) + cut) % np.uint64(PARTS)
    order = np.argsort(part, kind="stable")
    part, following = part[order].astype(np.int64), following[order]
    parts = part[starts_of(part)]
    return packed(pa.array([lang] * len(parts), pa.string()), parts, part, prefix[order], known, names.take(pa.array(following)), count[order])


def stripes(blocks: DataFrame, width: int, bitmap: np.ndarray | None = None, hot: set[tuple[str, str]] = frozenset()) -> DataFrame:
    """``(lang, part, prefixes, sizes, nexts, counts)``: per block and prefix of ``width - 1`` words its next words and their counts.

    A block has ``PARTS`` rows at most, each with the stripes of some prefixes. The stripe of a ``hot`` ``(lang, prefix)`` is cut over
    ``HOT_PARTS`` of them by a hash of the next word, so that no task merges all of it.
    """
    ship(blocks.sparkSession)
    sent = blocks.sparkSession.sparkContext.broadcast((bitmap, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, frequent = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                lang, words, ids = (batch.column(c)[i].as_py() for c in ("lang", "words", "ids"))
                words = words.split(b"\n") if words else []
                yield block_stripes(lang, words, np.frombuffer(ids, np.int32), width, bits, {p for of, p in frequent if of == lang})

    return blocks.mapInArrow(run, STRIPE)


def merged(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """Sorted bundles with those of one lang and part added up: first row of each; per entry the number of its bundle and of its
    prefix, all prefixes, next words and counts."""
    n = rows.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for c in ("lang", "part"):
        column = rows.column(c)
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    bundle = np.cumsum(new) - 1
    prefixes = pc.split_pattern(rows.column("prefixes"), "\n")
    sizes, counts = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.int64) for c in ("sizes", "counts"))
    known, nexts = prefixes.flatten().dictionary_encode(), pc.split_pattern(rows.column("nexts"), "\n").flatten().dictionary_encode()
    stripe = np.repeat(bundle, np.diff(prefixes.offsets.to_numpy())) << 32 | known.indices.to_numpy()
    stripes_of, number = np.unique(stripe, return_inverse=True)
    entry = np.repeat(number, sizes) << 32 | nexts.indices.to_numpy()
    order = np.argsort(entry, kind="stable")
    entry = entry[order]
    starts = starts_of(entry)
    sums = np.add.reduceat(counts[order], starts) if len(starts) else counts
    own = stripes_of[entry[starts] >> 32]
    following = nexts.dictionary.take(pa.array(entry[starts] & 0xFFFFFFFF))
    return np.flatnonzero(new), own >> 32, own & 0xFFFFFFFF, known.dictionary, following, sums


def merge_stripes(rows: DataFrame, least: int, rest: bool = False) -> DataFrame:
    """``(lang, prefix, next, n)``: the entries of elementwise merged stripes that reach ``least``.

    With ``rest``, all others of a bundle and prefix make one entry with a null ``next``, so that totals stay whole. Rows are
    dealt by lang and part and merged in order, some at a time; of a part that goes on in the next ones the merged bundle is kept.
    """
    dealt = rows.repartition("lang", "part").sortWithinPartitions("lang", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries(batch: pa.RecordBatch, first, bundle, prefix, known, nexts, sums) -> pa.RecordBatch:
            big = sums >= least
            of, at, n, following = bundle[big], prefix[big], sums[big], nexts.filter(pa.array(big))
            if rest:
                stripe, number = np.unique(bundle[~big] << 32 | prefix[~big], return_inverse=True)
                small = np.zeros(len(stripe), np.int64)
                np.add.at(small, number, sums[~big])
                of, at, n = np.r_[of, stripe >> 32], np.r_[at, stripe & 0xFFFFFFFF], np.r_[n, small]
                following = pa.concat_arrays([following, pa.nulls(len(stripe), pa.string())])
            langs = batch.column("lang").take(pa.array(first[of]))
            return pa.RecordBatch.from_arrays([langs, known.take(pa.array(at)), following, pa.array(n, pa.int64())], ["lang", "prefix", "next", "n"])

        kept: pa.RecordBatch | None = None
        for batch in slices(batches, "nexts", MERGE_BYTES):
            if kept is not None:
                batch = pa.concat_batches([kept, batch.cast(STRIPE_TYPE)])
            first, bundle, prefix, known, nexts, sums = merged(batch)
            last = len(first) - 1
            done = int(np.searchsorted(bundle, last))
            yield entries(batch, first[:last], bundle[:done], prefix[:done], known, nexts.slice(0, done), sums[:done])
            row = batch.slice(int(first[last]), 1)
            kept = packed(
                row.column("lang"), row.column("part").to_numpy(), np.zeros(len(sums) - done, np.int64), prefix[done:], known, nexts.slice(done), sums[done:]
            )
        if kept is not None:
            yield entries(kept, *merged(kept))

    return dealt.mapInArrow(run, ENTRY)


def frequent_bitmap(phrases: DataFrame) -> np.ndarray:
    """A bitmap of ``2 ** BITS`` bits with those of all ``(lang, phrase)``; brought to the driver in words of 64 bits, so its size is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                hashes = word_hashes(lang, phrase.encode().split(b" "))
                whole = hashes[:1]
                for k in range(1, len(hashes)):
                    whole = longer_hash(whole, hashes[k : k + 1])
                bits.append(int(bit_of(whole)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64())], ["bit"])

    set_bits = phrases.select("lang", "phrase").mapInArrow(run, "bit long")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))
    words = set_bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(one).alias("word")).toArrow()
    bitmap = np.zeros(1 << (BITS - 6), np.uint64)
    bitmap[words.column("at").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
    return bitmap


def phrase_counts(
    docs: DataFrame, longest: int = 5, least: int = 100, unknown: str = "und", block_words: int = BLOCK_WORDS
) -> tuple[DataFrame, DataFrame]:
    """``(lang, width, phrase, f)`` of all phrases of up to ``longest`` words that occur ``least`` times or more, and ``(lang, n)``, all words."""
    blocks, path = stage_at(word_blocks(docs, unknown, block_words), "word-blocks", compression="zstd")
    levels, bitmap, words, hot, n_words = [], None, None, set(), 0
    for width in range(1, longest + 1):
        entries = stage(merge_stripes(stripes(blocks, width, bitmap, hot), least, rest=width == 1), "stripes")
        if width == 1:
            words = entries.groupBy("lang").agg(F.sum("n").alias("n"))
            n_words = entries.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        whole = F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
        level = entries.where(F.col("next").isNotNull()).select(
            "lang", F.lit(width).alias("width"), whole.alias("phrase"), F.col("n").alias("f")
        )
        levels.append(level)
        if level.isEmpty():
            break
        if width < longest:
            bitmap = frequent_bitmap(level)
            # A thousand at most, as their occurrences are different places.
            hot = {(r["lang"], r["phrase"]) for r in level.where(F.col("f") * HOT_SHARE >= n_words).collect()}
    drop_stage(docs.sparkSession, path)
    return reduce(DataFrame.unionByName, levels), words


def collocations(
    docs: DataFrame,
    top: int = 2000,
    longest: int = 5,
    least: int = 100,
    share: int = 100,
    unknown: str = "und",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each lang's ``top`` phrases of 2 to ``longest`` words by how much more often their
    words stand together than their parts would by chance.

    ``a`` is the phrase's frequency, ``least`` or more, overlapping occurrences included; ``n`` counts the lang's words. A cut
    after ``k`` words has the parts' frequencies ``l`` and ``r`` and scores ``floor(1000 * a * n / (l * r))``; the cut
    with the lowest score, then the smallest ``k``, counts. A phrase is left out if a longer one that
    holds it has ``share`` hundredths of its frequency or more. Higher scores, then higher ``a``, then smaller phrases (by UTF-8 bytes)
    go first. All arithmetic is exact.

    Null texts have no words, a null lang is ``unknown`` (as is a lang of that name); every row counts, repeated ones too;
    other columns than ``lang`` and ``text`` are not read; an empty table gives no rows.
    """
    counted, words = phrase_counts(docs, longest, least, unknown, block_words)
    candidates = counted.where("width > 1").withColumnRenamed("f", "a")
    parts = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "a", parts.alias("words"), F.explode(F.sequence(F.lit(1), F.col("width") - 1)).alias("k")).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("right"),
    )
    known = counted.select(F.col("lang").alias("of"), F.col("phrase").alias("known"), "f")
    for side, name in (("left", "l"), ("right", "r")):
        own = known.withColumnRenamed("f", name)
        cuts = cuts.join(own, (F.col("lang") == F.col("of")) & (F.col(side) == F.col("known"))).drop("of", "known")
    exact = lambda c: f"CAST({c} AS DECIMAL(19, 0))"  # noqa: E731  two of them multiply to 38 digits
    score = F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {exact('a')} * {exact('n')}) DIV ({exact('l')} * {exact('r')})")
    lowest = (
        cuts.join(words, "lang")
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    )
    # The most frequent phrase that is longer by one word; one that is longer by more is never more frequent.
    longer = counted.where("width > 2").select("lang", "f", parts.alias("words"))
    within = lambda begin: F.array_join(F.slice("words", F.lit(begin), F.size("words") - 1), " ").alias("phrase")
    extended = longer.select("lang", within(1), "f").unionByName(longer.select("lang", within(2), "f"))
    extended = extended.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = lowest.join(extended, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
