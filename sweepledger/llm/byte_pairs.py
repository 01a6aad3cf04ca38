"""Byte-level pair ids of whole texts, with the parts met before kept at hand.

The library encodes about a megabyte a second, most of it for words it has seen. Its pattern
never lets a token cross certain places (a space between words, a line end, the border of ASCII letters and
punctuation), so a text's ids are those of its parts one after the other, and each distinct
part is encoded once. Ids stand in one array; texts are gathered from it.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The white space of the library's pattern.
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LETTER = "A-Za-zÀ-ÖØ-öø-ʯ"
# ASCII punctuation without the apostrophe, which can begin a contraction.
MARK = r"!-&(-/:-@\[-`{-~"
# Parts whose borders are borders of tokens: pure letters or pure punctuation up to the other kind, else all up to white space.
PART = re.compile(
    f" ?[{LETTER}]+(?=[{MARK}{BLANK}]|\\Z)| ?[{MARK}]+(?=[{LETTER}{BLANK}]|\\Z)| ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]"
)
BLANKS = re.compile(f"[{BLANK}]")
# Parts and words are kept while they hold no more than this together; longer ones are encoded again each time.
HELD_BYTES, ENTRY_BYTES = 160 << 20, 160
LONGEST = 64
# Parts that are one word of the library's pattern as they are, so that its model can take them directly.
SINGLE = re.compile(f" ?[{LETTER}]+| ?[{MARK}]+")


def byte_letters() -> dict[int, int]:
    """The model's letter for each byte: itself where it is printable, else one after the other from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


class IdRows:
    """Rows of ids by number, one after the other in one array; row 0 has none."""

    def __init__(self):
        self.ids, self.bounds, self.n = np.zeros(1 << 16, "<i4"), np.zeros(1 << 14, np.int64), 1

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of new rows, whose ids are ``ids`` one after the other."""
        held, n = int(self.bounds[self.n]), self.n + len(sizes)
        self.ids, self.bounds = _room(self.ids, held + len(ids)), _room(self.bounds, n + 1)
        self.ids[held : held + len(ids)] = ids
        self.bounds[self.n + 1 : n + 1] = held + np.cumsum(sizes)
        numbers, self.n = np.arange(self.n, n), n
        return numbers

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows one after the other, and how many each has."""
        starts = self.bounds[numbers]
        sizes = self.bounds[numbers + 1] - starts
        ends = np.cumsum(sizes)
        at = np.repeat(starts - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.ids[at], sizes

    def cut(self, n: int) -> None:
        """Forget all rows from number ``n`` on."""
        self.n = n


class Known(dict):
    """Numbers of rows by text, of short texts only; counts the bytes that these and their ids hold, about."""

    held = 0

    def keep(self, texts: list[str], numbers: np.ndarray, sizes: np.ndarray) -> None:
        self.update(zip(texts, numbers.tolist()))
        self.held += ENTRY_BYTES * len(texts) + sum(map(len, texts)) + 4 * int(sizes.sum())


def _room(array: np.ndarray, least: int) -> np.ndarray:
    return array if len(array) >= least else np.concatenate([array, np.zeros(max(least, 2 * len(array)) - len(array), array.dtype)])


class BytePairs:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        kind = json.loads(self.library.to_str())
        split = kind["pre_tokenizer"] or {}
        if kind["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
            raise ValueError(f"{path}: not a byte-level tokenizer with the usual pattern")
        self.special = [t["content"] for t in kind["added_tokens"]]
        self.size = self.library.get_vocab_size()
        self.model = self.library.model
        self.letters = byte_letters()
        space = chr(self.letters[0x20])
        self.spaced = np.zeros(max(self.library.get_vocab(True).values()) + 1, bool)
        self.spaced[[i for token, i in self.library.get_vocab(False).items() if token[0] == space]] = True
        # New words encoded in one text; one each if a special token could stand across the space between two.
        self.together = 1 if any(" " in s for s in self.special) else 100
        self._forget()

    def _forget(self) -> None:
        self.rows = IdRows()
        self.words, self.parts = Known(), Known()  # words by what follows the space before them, parts with all they hold

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit little-endian integers."""
        ids, sizes = self.encode_flat(texts)
        data, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [data[e - n : e] for e, n in zip(ends, (4 * sizes).tolist())]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has.

        Texts are cut at spaces first: a space after which no white space follows begins a token. A text with other
        spaces (two in a row, at its end, before a line end) is cut into parts as a whole. The distinct words of all texts
        are looked up once, and the ids of their places gathered from one array.
        """
        if not texts:
            return np.zeros(0, "<i4"), np.zeros(0, np.int64)
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        starts = cut.offsets.to_numpy().astype(np.int64)
        firsts, ends = starts[:-1], starts[1:]
        coded = cut.values.dictionary_encode()
        at = coded.indices.to_numpy()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        spaced = np.ones(len(at), bool)
        spaced[firsts] = False  # no space before a text's first word
        special = [i for i, text in enumerate(texts) if any(s in text for s in self.special)]
        for i in special:
            spaced[firsts[i] : ends[i]] = False
        used = np.zeros(len(words), bool)
        used[at[spaced]] = True
        numbers = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero((numbers < 0) & used).tolist()
        odd = [k for k in new if not words[k] or BLANKS.match(words[k])]
        whole = set()
        if odd:
            numbers[odd] = 0
            is_odd = np.zeros(len(words), bool)
            is_odd[odd] = True
            whole.update((np.searchsorted(firsts, np.flatnonzero(is_odd[at] & spaced), "right") - 1).tolist())
            gone = set(odd)
            new = [k for k in new if k not in gone]
        alone = [texts[i] if i in whole else words[k] for i, k in enumerate(at[firsts].tolist())]
        for i in special:
            alone[i] = ""
        alone_ids, alone_sizes = self._by_parts(alone)
        new.sort(key=lambda k: len(words[k]) > LONGEST)
        numbers[new], kept = self._learn([words[k] for k in new])
        numbers[~used] = 0
        rows = numbers[at]
        for i in whole.union(special):
            rows[firsts[i] : ends[i]] = 0
        # Rows from here on are of this call only: long words, first words, whole texts.
        rows[firsts] = self.rows.add(alone_ids, alone_sizes)
        for i in special:
            ids = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, "<i4")
            rows[firsts[i]] = self.rows.add(ids, np.array([len(ids)]))[0]
        ids, sizes = self.rows.take(rows)
        if self.words.held + self.parts.held > HELD_BYTES:
            self._keep_only([words[k] for k in np.flatnonzero((numbers > 0) & (numbers < kept)).tolist()])
        else:
            self.rows.cut(kept)
        return ids, np.add.reduceat(sizes, firsts)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, int]:
        """Numbers of new words with a space before them, and the number up to which rows are kept; longer words come last.

        The library encodes many at a time: only a word's first id begins with a space.
        """
        texts = [" " + " ".join(words[i : i + self.together]) for i in range(0, len(words), self.together)]
        encoded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array([], "<i4"), *[np.array(e.ids, "<i4") for e in encoded]])
        first = np.flatnonzero(self.spaced[ids])
        sizes = np.diff(first, append=len(ids))
        if len(first) != len(words):  # a vocabulary without the letter of a space
            ids, sizes = self._by_parts([" " + w for w in words])
        numbers = self.rows.add(ids, sizes)
        n = sum(len(w) <= LONGEST for w in words)
        self.words.keep(words[:n], numbers[:n], sizes[:n])
        return numbers, int(numbers[n]) if n < len(words) else self.rows.n

    def _keep_only(self, recent: list[str]) -> None:
        """Forget all but the words met last, and these too when they alone hold half of what is allowed."""
        ids, sizes = self.rows.take(np.fromiter(map(self.words.get, recent), np.int64, len(recent)))
        self._forget()
        self.words.keep(recent, self.rows.add(ids, sizes), sizes)
        if self.words.held > HELD_BYTES // 2:
            self._forget()

    def _by_parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has; new short parts are kept."""
        all_parts: list[str] = []
        n_parts = []
        for text in texts:
            cut = PART.findall(text)
            all_parts += cut
            n_parts.append(len(cut))
        found: dict[str, int | None] = {p: self.parts.get(p) for p in dict.fromkeys(all_parts)}
        new = sorted((p for p, number in found.items() if number is None), key=lambda p: len(p) > LONGEST)
        ids, sizes = self._encode_each(new)
        numbers = self.rows.add(ids, sizes)
        found.update(zip(new, numbers.tolist()))
        n = sum(len(p) <= LONGEST for p in new)
        self.parts.keep(new[:n], numbers[:n], sizes[:n])
        ids, sizes = self.rows.take(np.fromiter(map(found.__getitem__, all_parts), np.int64, len(all_parts)))
        self.rows.cut(self.rows.n - len(new) + n)
        return ids, np.diff(np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(n_parts, dtype=np.int64)]])

    def _encode_each(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts and how many each has: single ones by the library's model, the others by the whole library."""
        is_single = [SINGLE.fullmatch(p) is not None for p in parts]
        singles = list(compress(parts, is_single))
        # The model's letters stand for bytes; no single part holds a line end.
        spelt = "\n".join(singles).encode().decode("latin-1").translate(self.letters).split(chr(self.letters[0x0A]))
        by_model = map(self.model.tokenize, spelt if singles else ())
        by_library = iter(self.library.encode_batch_fast([p for p in parts if not SINGLE.fullmatch(p)], add_special_tokens=False))
        ids: list[int] = []
        ends = [0]
        for single in is_single:
            ids += [t.id for t in next(by_model)] if single else next(by_library).ids
            ends.append(len(ids))
        return np.array(ids, "<i4"), np.diff(ends)


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use all cores
    return BytePairs(path)
