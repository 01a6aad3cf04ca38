"""Piece ids of a byte-pair model with byte fallback, by vectorised merge rounds.

Texts are cut into words at the places no piece crosses, and each batch's words that are not
yet known go through the rounds together. Their symbols lie in one flat array. A round
takes every word's best pair (one segmented minimum), merges its occurrences from the left in
all words at once and closes the gaps; words without a pair leave. The rounds end
when no word is left.

The order is that of a queue of single merges, best score first and leftmost among equals: a
round merges several occurrences of a word's best pair only as far as none of the pairs that
come into being would go before the next occurrence.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship, slices

SPACE = "▁"
NONE = np.iinfo(np.int32).max
SHIFT = 21  # a symbol is a piece id, or the vocabulary's size plus a code point; both fit
CACHED_WORDS, LONGEST = 300_000, 64  # words kept, of so many characters at most; longer ones are encoded each time
DECODED_IDS = 1 << 20


class Pieces:
    """A model's pieces, the pairs that merge into them, and the words met so far."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        if model.normalize("ﬁ  x ") != f"{SPACE}ﬁ{SPACE}{SPACE}x{SPACE}":
            raise ValueError(f"{path}: its normaliser changes more than spaces")
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(self.size)]
        if not model.is_byte(model.piece_to_id("<0x00>")):
            raise ValueError(f"{path}: no byte pieces")
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        names = {model.id_to_piece(i): i for i in range(self.size) if not special[i]}
        # What each id stands for, as one flat array of bytes: a piece's text, a byte piece's byte, nothing for a control id.
        byte_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        text = [
            byte_of[i] if i in byte_of
            else model.id_to_piece(i).replace(SPACE, " ").encode() if not special[i]
            else model.decode([i]).encode()
            for i in range(self.size)
        ]
        self.flat = np.frombuffer(b"".join(text), np.uint8)
        self.widths = np.array(list(map(len, text)), np.int64)
        self.starts = np.cumsum(self.widths) - self.widths
        self.spaced = np.array([not special[i] and t.startswith(b" ") for i, t in enumerate(text)])
        self.ids = names
        scores = {i: model.get_score(i) for i in names.values()}
        order = {score: k for k, score in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs: dict[int, tuple[int, int]] = {}
        for name, i in names.items():
            for cut in range(1, len(name)):
                left, right = self.symbol(name[:cut]), self.symbol(name[cut:])
                if left is not None and right is not None:
                    pairs[left << SHIFT | right] = (i, order[scores[i]])
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.ranks = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        self.pairs = pairs
        self.last_rank = len(order) - 1
        # Words begin at a space after something else, if no piece has one there.
        self.words_at_spaces = not any(SPACE in name.lstrip(SPACE) for name in names)
        self.lines_apart = not any("\n" in name and len(name) > 1 for name in names)
        self.known: dict[str, bytes] = {}

    def symbol(self, text: str) -> int | None:
        if text in self.ids:
            return self.ids[text]
        return self.size + ord(text) if len(text) == 1 else None

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece each pair merges into and its rank, ``NONE`` if there is none."""
        key = left << SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return self.merged[at], np.where(found, self.ranks[at], NONE)

    def merge(self, words: list[str]) -> list[list[int]]:
        """Final symbols of each word, none of them empty."""
        out: list[list[int]] = [[] for _ in words]
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        distinct, inverse = np.unique(points, return_inverse=True)
        symbols = np.array([self.symbol(chr(c)) for c in distinct.tolist()], np.int64)[inverse]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        rank = np.full(len(symbols), NONE, np.int32)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self.look_up(symbols[inside], symbols[inside + 1])[1]
        while len(symbols):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[start, len(symbols)])
            best = np.minimum.reduceat(rank, start)
            over = (best == NONE) | (best == self.last_rank)
            if over.any():
                for k in np.flatnonzero(over).tolist():
                    tail = symbols[start[k] : start[k] + count[k]].tolist()
                    out[word[start[k]]] = tail if best[k] == NONE else self._from_left(tail)
                stay = np.repeat(~over, count)
                symbols, word, rank = symbols[stay], word[stay], rank[stay]
                continue
            lowest = np.repeat(best, count)
            at = np.flatnonzero(rank == lowest)
            # Overlapping occurrences: every second one of a run, from the left.
            fresh_run = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
            place = np.arange(len(at)) - np.repeat(fresh_run, np.diff(np.r_[fresh_run, len(at)]))
            at = at[place % 2 == 0]
            piece, r = self.look_up(symbols[at], symbols[at + 1])
            # Pairs that come into being, with the occurrence before already merged.
            before, after = np.maximum(at - 1, 0), np.minimum(at + 2, len(symbols) - 1)
            left = symbols[before]
            near = np.flatnonzero(at[1:] == at[:-1] + 2) + 1
            left[near] = piece[near - 1]
            goes_left = np.where((at > 0) & (word[before] == word[at]), self.look_up(left, piece)[1], NONE)
            goes_right = np.where((at + 2 < len(symbols)) & (word[after] == word[at]), self.look_up(piece, symbols[after])[1], NONE)
            stops = np.minimum(goes_left, goes_right) <= r
            passed = np.cumsum(stops) - stops
            first = np.flatnonzero(np.r_[True, word[at][1:] != word[at][:-1]])
            in_word = np.repeat(passed[first], np.diff(np.r_[first, len(at)]))
            do = passed == in_word
            at, piece = at[do], piece[do]
            symbols[at] = piece
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            moved = at - np.arange(len(at))  # each merge before takes one place away
            symbols, word, rank = symbols[stay], word[stay], rank[stay]
            rank[moved] = NONE
            for p in (moved, moved[moved > 0] - 1):
                p = p[p + 1 < len(symbols)]
                p = p[word[p] == word[p + 1]]
                rank[p] = self.look_up(symbols[p], symbols[p + 1])[1]
        return out

    def _from_left(self, symbols: list[int]) -> list[int]:
        """Only merges of the last rank remain, so the leftmost always goes first."""
        done: list[int] = []
        for s in symbols:
            done.append(s)
            while len(done) > 1 and (pair := self.pairs.get(done[-2] << SHIFT | done[-1])):
                done[-2:] = [pair[0]]
        return done

    def cut(self, text: str) -> list[str]:
        """Words whose pieces do not depend on each other; they make up the text with its first space.

        A word without a space mark or line end in front stands for itself with a space.
        """
        words = (text.replace("\n", " \n") if self.lines_apart else text).split(" ")
        if self.words_at_spaces and "" not in words and SPACE not in text and " \n" not in text:
            return words
        whole = SPACE + text.replace(" ", SPACE)
        if not self.words_at_spaces:
            return [whole]
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", whole)

    def encode_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as 32-bit integers."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        cut = [self.cut(t) if t else [] for t in texts]
        new = list({w for words in cut for w in words if w not in self.known})
        long: dict[str, bytes] = {}
        plain = [w if w[0] in (SPACE, "\n") else SPACE + w for w in new]
        for word, symbols in zip(new, self.merge(plain) if plain else []):
            ids = []
            for s in symbols:
                if s < self.size:
                    ids.append(s)
                else:
                    ids.extend(self.byte_ids[b] for b in chr(s - self.size).encode("utf-8", "surrogatepass"))
            (self.known if len(word) <= LONGEST else long)[word] = np.array(ids, np.int32).tobytes()
        if not long:
            return [b"".join(map(self.known.__getitem__, words)) for words in cut]
        return [b"".join([long[w] if w in long else self.known[w] for w in words]) for words in cut]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.StringArray:
        """Texts of ids that lie one text after the other, each up to before its ``ends``.

        Byte pieces are joined to characters; a byte that is part of none becomes U+FFFD. The
        space put before a text is dropped from its first piece. Nothing but ids is needed, so they may come from anywhere.
        """
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < self.size:
            raise ValueError("an id is not of the model")
        widths, starts = self.widths[ids], self.starts[ids]
        # The first piece of each text that is not empty loses its space.
        seen = np.r_[0, np.cumsum(widths > 0)]
        begins = np.r_[0, ends[:-1]] if len(ends) else ends
        some = seen[ends] > seen[begins]
        first = np.searchsorted(seen, seen[begins[some]], side="right") - 1
        first = first[self.spaced[ids[first]]]
        widths[first] -= 1
        starts[first] += 1
        reach = np.cumsum(widths)
        data = self.flat[np.repeat(starts - reach + widths, widths) + np.arange(int(widths.sum()))]
        offsets = np.r_[0, reach][np.r_[0, ends]]
        whole = data.tobytes()
        inside = offsets[:-1][offsets[:-1] < offsets[1:]]
        try:
            whole.decode()
            valid = not ((data[inside] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            valid = False
        if valid:
            return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(whole))
        at = offsets.tolist()
        return pa.array([whole[b:e].decode("utf-8", "each-byte") for b, e in zip(at, at[1:])], pa.string())

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids (as 32-bit integers) of each text, and the bytes that these ids decode to."""
        found = self.encode_ids(texts)
        ends = np.cumsum([len(ids) // 4 for ids in found], dtype=np.int64)
        decoded = self.decode(np.frombuffer(b"".join(found), np.int32), ends)
        return [(ids, text.encode()) for ids, text in zip(found, decoded.to_pylist())]


codecs.register_error("each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_pieces(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (string), as the model's library encodes and decodes.

    ``decoded`` is decoded from the ids, as by ``decode_pieces``. Whole texts, no begin or end ids, no sampling. A null text counts as empty: no ids, an
    empty decoded text. Every row is encoded for itself, so repeated rows and any keys are
    fine; an empty table gives no rows. Input columns called ``ids`` or ``decoded`` are
    replaced. ``model`` is a path at which every executor finds the model file. No shuffle;
    a task holds about 4 MB of texts (one text at least) and a bounded set of known words.
    """
    ship(docs.sparkSession)
    kept = docs.select(*[c for c in docs.columns if c.lower() not in ("ids", "decoded")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(model)
        for batch in slices(batches, text):
            encoded = known.encode_ids(batch.column(text).to_pylist())
            offsets = np.cumsum([0, *(len(ids) // 4 for ids in encoded)], dtype=np.int32)
            flat = np.frombuffer(b"".join(encoded), np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, decoded_of(known, ids)], [*batch.schema.names, "ids", "decoded"])

    return kept.mapInArrow(run, f"{_ddl(kept)}, ids array<int>, decoded string")


def decoded_of(known: Pieces, ids: pa.ListArray) -> pa.StringArray:
    """The text of each list of ids, null for a null one."""
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    flat = ids.flatten()
    if flat.null_count:
        raise ValueError("an id is null")
    texts = known.decode(flat.to_numpy(zero_copy_only=False), np.cumsum(sizes, dtype=np.int64))
    return pc.if_else(ids.is_null(), pa.scalar(None, pa.string()), texts) if ids.null_count else texts


def decode_pieces(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of the array of int ``ids``, as the model's library decodes it.

    Only the ids are read, wherever they come from; an id that is not of the model, or null, is an error, a null array
    has a null text. An input column called ``decoded`` is replaced. No shuffle; a task decodes about a million ids
    (one row at least) at a time.
    """
    ship(encoded.sparkSession)
    kept = encoded.select(*[c for c in encoded.columns if c.lower() != "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(model)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(sizes) // DECODED_IDS
            for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(group)) + 1):
                part = batch.slice(int(rows[0]), len(rows)) if len(rows) else batch
                decoded = decoded_of(known, part.column(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], [*part.schema.names, "decoded"])

    return kept.mapInArrow(run, f"{_ddl(kept)}, decoded string")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def piece_digest(encoded: DataFrame, *more: str) -> DataFrame:
    """Per document: its number of ids, checksums of the ids and of the decoded text, and the columns ``more``."""
    return encoded.select(
        "doc_id",
        *more,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
